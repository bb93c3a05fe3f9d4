"""Spark-first retrieval, record-lifecycle and evaluation engine.

Every operator is a function from DataFrames to DataFrames; nothing here keeps
its own storage or threads.  ``quarry.engine.Engine`` ties the operators to a
table location for callers who want verbs instead of functions.
"""

__version__ = "0.1.0"
