"""Operators that prepare large text corpora for language-model training.

Each module holds one operator; ``queries`` registers them.  Nothing outside this
subpackage imports it.
"""
