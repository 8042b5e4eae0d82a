"""Operators of a training-data pipeline: mixing, filtering, deduplication, formatting, search.

Nothing else in the package imports this folder.  Operators take and return DataFrames;
``registry`` holds the queries and their SQL.
"""
