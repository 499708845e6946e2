"""Operators on DataFrames: joins, set operations, windows, recursion, changes of rows, time travel, policies, search."""
