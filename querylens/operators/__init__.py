"""Relational operators over query-log DataFrames."""
