"""Catalog statistics and column profiling.

The per-database catalog arrives as tables (``catalog_tables`` with one
row per table: db_id, table_name, row_count, n_indexes).  Statistics are
one grouped aggregate; value samples rank distinct values per column with the
range-partitioned ranking and profiles count values by their digits, so a very
large column is never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from .ranking import rank_within, values_at

SCHEMA_FEATURES = ["schema_n_tables", "schema_total_rows", "schema_max_table_rows",
                   "schema_total_indexes", "schema_index_coverage", "schema_log_total_rows"]


def schema_stats(catalog_tables: DataFrame, db_col: str = "db_id") -> DataFrame:
    """Per database #tables, total rows, max table rows, total indexes,
    share of tables with an index (0 without tables) and ln(1 + total rows)."""
    g = catalog_tables.groupBy(db_col).agg(
        F.count(F.lit(1)).alias("schema_n_tables"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("schema_total_rows"),
        F.coalesce(F.max("row_count"), F.lit(0)).alias("schema_max_table_rows"),
        F.coalesce(F.sum("n_indexes"), F.lit(0)).alias("schema_total_indexes"),
        F.avg((F.col("n_indexes") > 0).cast("double")).alias("_cov"))
    return g.select(db_col, "schema_n_tables", "schema_total_rows", "schema_max_table_rows",
                    "schema_total_indexes", F.coalesce(F.col("_cov"), F.lit(0.0)).alias("schema_index_coverage"),
                    F.log1p(F.col("schema_total_rows").cast("double")).alias("schema_log_total_rows"))


def table_row_counts(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``COUNT(*)`` of each registered table as one unioned DataFrame
    (each count is a separate aggregate; parquet answers it from metadata)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _type_name(dt) -> str:
    if isinstance(dt, (ArrayType, MapType, StructType)):
        return dt.simpleString().upper()
    return dt.simpleString().upper()


def inspect_schema(spark: SparkSession, db_id: str, tables: dict[str, DataFrame],
                   primary_keys: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """``catalog_columns`` rows (db_id, table_name, col_name, ctype,
    notnull, pk) from the schemas of the given tables; only schema metadata
    passes through the driver (one row per column)."""
    pks = primary_keys or {}
    rows = []
    for t, df in tables.items():
        for pos, f in enumerate(df.schema.fields):
            rows.append((db_id, t, pos, f.name, _type_name(f.dataType) or "TEXT", int(not f.nullable),
                         int(f.name in pks.get(t, ()))))
    return spark.createDataFrame(rows, "db_id string, table_name string, col_pos int, col_name string, "
                                       "ctype string, notnull int, pk int")


def join_catalog(log: DataFrame, stats: DataFrame, db_col: str = "db_id") -> DataFrame:
    """C4: left join of the log with per-db statistics; a database without
    statistics gets nulls.  Stale ``schema_*`` columns are dropped first so
    names never clash."""
    base = log.drop(*[c for c in log.columns if c.startswith("schema_")])
    return base.join(stats, on=db_col, how="left")


def _long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cols = list(columns)
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col_name"), F.col(c).cast("string").alias("value")) for c in cols])).alias("_kv"))
    return stacked.select("_kv.col_name", "_kv.value")


def value_samples(df: DataFrame, columns: Sequence[str], k: int = 8) -> DataFrame:
    """Per column, the first ``5k`` distinct non-null values in value
    order, then every ``max(1, m // k)``-th of those, at most ``k``.
    Output: col_name, sample_pos, value (as string)."""
    vals = _long_values(df, columns).where(F.col("value").isNotNull()).distinct()
    r = rank_within(vals, ["col_name"], [F.col("value").asc()])
    first = r.where(F.col("_rn") < 5 * k)
    m = F.least(F.col("_n"), F.lit(5 * k))
    step = F.greatest(F.lit(1), F.floor(m / k).cast("long"))
    picked = first.where(F.col("_rn") % step == 0).withColumn("sample_pos", (F.col("_rn") / step).cast("long"))
    return picked.where(F.col("sample_pos") < k).select("col_name", "sample_pos", "value")


def five_point(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank-floor quantiles at 0, .25, .5, .75, 1 (element
    ``min(n-1, floor(q (n-1)))`` of the sorted non-null values) per numeric
    column; a column without values gives nulls."""
    qs = [0.0, 0.25, 0.5, 0.75, 1.0]
    cols = list(columns)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col_name"), F.col(c).cast("double").alias("v")) for c in cols])).alias("_kv")
    ).select("_kv.col_name", "_kv.v")
    picked = values_at(long, "v", lambda n: [F.least(n - 1, F.floor(F.lit(q) * (n - 1)).cast("long")) for q in qs], ["col_name"],
                       large_groups=None)      # one group per column of a table
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "col_name string")
    labels = ["p0", "p25", "p50", "p75", "p100"]
    return names.join(picked, "col_name", "left").select(
        "col_name", *[F.col("values")[i].alias(lab) for i, lab in enumerate(labels)])
