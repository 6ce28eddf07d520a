"""Query history: append, views, counts, schema evolution, retraining input (H1-H8).

The history is an append-only table (one row per executed query).  All
operators are filters, projections, grouped aggregates and anti joins, so
they run unchanged on a history of any size; the Structured Streaming forms
are in :mod:`querylens.streaming.history_stream`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.sqltext import add_parsed_features
from .catalog import join_catalog
from .labels import label_quantile, threshold_label

HISTORY_SCHEMA = StructType([
    StructField("id", LongType()), StructField("timestamp", StringType()), StructField("database", StringType()),
    StructField("sql_text", StringType()), StructField("runtime_s", DoubleType()), StructField("row_count", LongType()),
    StructField("predicted_runtime_s", DoubleType()), StructField("predicted_label", StringType()),
    StructField("actual_label", StringType()), StructField("had_error", IntegerType())])


def append_history(existing: DataFrame | None, new_rows: DataFrame, ts_col: str | None = None) -> DataFrame:
    """H1: derive ``actual_label`` (0.050 s threshold, null on error), stamp
    an ISO-8601 UTC second-resolution timestamp (``ts_col`` when the rows
    carry their event time, else the current time) and append."""
    stamp = F.current_timestamp() if ts_col is None else F.col(ts_col)
    rows = new_rows.withColumn("actual_label", threshold_label(F.col("runtime_s"), F.col("had_error")))
    rows = rows.withColumn("timestamp", F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"))
    rows = evolve_history_schema(rows)
    return rows if existing is None else evolve_history_schema(existing).unionByName(rows)


def history_newest_first(history: DataFrame) -> DataFrame:
    """H2: all rows, newest id first."""
    return history.orderBy(F.desc("id"))


def valid_history(history: DataFrame) -> DataFrame:
    return history.where((F.col("had_error") == 0) & F.col("runtime_s").isNotNull()
                         & F.col("predicted_runtime_s").isNotNull())


def history_for_metrics(history: DataFrame) -> DataFrame:
    """H3: rows without error and with both runtimes, ordered by id."""
    return valid_history(history).select("id", "runtime_s", "predicted_runtime_s", "actual_label",
                                         "predicted_label").orderBy("id")


def history_counts(history: DataFrame) -> DataFrame:
    """H4: total, errors, valid (metrics-ready) and trainable (no error, runtime present)."""
    err = F.col("had_error") != 0
    return history.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(err).alias("errors"),
        F.count_if(~err & F.col("runtime_s").isNotNull() & F.col("predicted_runtime_s").isNotNull()).alias("valid"),
        F.count_if(~err & F.col("runtime_s").isNotNull()).alias("trainable"))


def history_by_database(history: DataFrame) -> DataFrame:
    """H5: per database the query count and mean actual / predicted ms
    (null when no value is present)."""
    return history.groupBy("database").agg(
        F.count("id").alias("queries"),
        (F.avg("runtime_s") * 1000).alias("avg_actual_ms"),
        (F.avg("predicted_runtime_s") * 1000).alias("avg_predicted_ms"))


def evolve_history_schema(df: DataFrame, schema: StructType = HISTORY_SCHEMA) -> DataFrame:
    """H6: add every missing history column as a typed null, in schema order
    (extra columns are kept at the end)."""
    present = set(df.columns)
    cols = [(F.col(f.name).cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields]
    extra = [c for c in df.columns if c not in {f.name for f in schema.fields}]
    return df.select(*cols, *extra)


def history_training_rows(history: DataFrame, stats: DataFrame) -> DataFrame:
    """Valid history rows as training rows: key ``history_<id>``, difficulty
    'unknown', SQL features and catalog statistics."""
    rows = history.where((F.col("had_error") == 0) & F.col("runtime_s").isNotNull() & (F.col("runtime_s") > 0))
    rows = rows.select(F.concat(F.lit("history_"), F.col("id").cast("string")).alias("question_id"),
                       F.col("database").alias("db_id"), F.col("sql_text").alias("sql"),
                       F.lit("unknown").alias("difficulty"), "runtime_s")
    return join_catalog(add_parsed_features(rows), stats)


def merge_history_into_training(existing: DataFrame, history: DataFrame, stats: DataFrame) -> DataFrame:
    """H7: new history rows (anti join on ids already present), union with
    the existing training rows, keep runtime > 0, add ``log_runtime`` and
    relabel by quantiles over the merged table.  Pass the raw log as
    ``existing`` to relabel from raw runtimes; pass an already labelled table
    to reproduce the reference's drifting cutoffs."""
    new = history_training_rows(history, stats)
    base = existing.withColumn("question_id", F.col("question_id").cast("string"))
    base = base.drop("label", "label_binary", "log_runtime")
    new = new.join(base.select("question_id"), "question_id", "left_anti")
    merged = base.unionByName(new, allowMissingColumns=True)
    merged = merged.where(F.col("runtime_s") > 0).withColumn("log_runtime", F.ln("runtime_s"))
    return label_quantile(merged)


def replace_subset(existing: DataFrame, fresh: DataFrame, dbs: Sequence[str], db_col: str = "db_id") -> DataFrame:
    """H8: drop the rows of the listed databases, union the fresh rows of
    those databases, rebuild features and labels."""
    dbs = list(dbs)
    keep = existing.where(~F.col(db_col).isin(dbs))
    new = fresh.where(F.col(db_col).isin(dbs))
    cols = ["question_id", db_col, "difficulty", "sql", "runtime_s"]
    merged = keep.select(*cols).unionByName(new.select(*cols))
    return label_quantile(add_parsed_features(merged))
