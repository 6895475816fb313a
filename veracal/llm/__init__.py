"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it.  Every module holds one operator with a general interface; ``queries`` binds
them to the tables of the test data.
"""
