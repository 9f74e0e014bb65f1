"""Training-data operators over large document corpora.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames and leaves intermediate tables only in the cluster's shared
checkpoint folder (see :mod:`lexloom.llm.common`).
"""
