"""querylens: query-log analytics expressed as Spark DataFrame jobs.

Sub-packages
------------
sources    readers, writers and the fixture tables derived from the driver parquet
functions  column expressions over SQL text and plan-node text (no UDFs)
operators  relational operators: labels, splits, catalog, metrics, reports, history, models
plans      plan-tree features and the relational workload shapes
streaming  Structured Streaming forms of the history operators
"""

__all__ = ["session"]
