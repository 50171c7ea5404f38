"""Operators for training-data pipelines (text tables in, DataFrames out).

Nothing else in the library imports this subpackage. Operators take
DataFrames and column names, select only the columns they need (extra
columns, whatever their names, never clash), and leave partitioning to
Spark. `queries.py` binds them to the given tables.
"""
