"""rostrum: Spark-first analytics over public-meeting records.

Operators are plain functions from DataFrames to DataFrames.  Nothing here starts a
session, collects an unbounded result, or imports the optional ``llm`` subpackage.
"""
