"""quillsift: a document search and corpus engine expressed in Spark DataFrames."""
