"""Storage: files, databases and tables of segments, JSON documents and changes to them."""
