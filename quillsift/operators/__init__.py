"""Operators over documents: filters, postings, search and compaction."""
