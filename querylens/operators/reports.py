"""Report tables (R1-R8): unpivots, histograms, counts, previews.

Everything is a grouped aggregate or projection; histogram bounds are one
global min/max aggregate attached as scalar subqueries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _report_value(df: DataFrame, c: str) -> Column:
    """Texts as they are, arrays, maps and structs as JSON, flags as true or
    false, numbers with 6 decimals."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.StringType):
        return F.col(c)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(F.col(c).isNotNull(), F.to_json(c))
    if isinstance(kind, T.NumericType):
        return F.when(F.col(c).isNotNull(), F.format_string("%.6f", F.col(c).cast("double")))
    return F.col(c).cast("string")


def metrics_long(df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str], iteration: str,
                 source_file: str, notes: str = "") -> DataFrame:
    """Unpivot wide report rows to ``bundle_key, iteration, value,
    source_file, source_field, notes``; see :func:`_report_value` for how
    values of each type are written, null stays null."""
    wide = df.select(*id_cols, *[_report_value(df, c).alias(c) for c in value_cols])
    long = wide.unpivot(list(id_cols), list(value_cols), "source_field", "value")
    key = F.concat_ws(".", *[F.col(c).cast("string") for c in id_cols], F.col("source_field"))
    return long.select(key.alias("bundle_key"), F.lit(iteration).alias("iteration"), "value",
                       F.lit(source_file).alias("source_file"), "source_field", F.lit(notes).alias("notes"))


def runtime_histogram(df: DataFrame, col: str = "runtime_s", bins: int = 30, log: bool = False) -> DataFrame:
    """R2: equal-width histogram between min and max (last bin closed).
    Returns bin, bin_lo, bin_hi, count for non-empty bins."""
    x = F.ln(col) if log else F.col(col).cast("double")
    vals = df.select(x.alias("_x")).where(F.col("_x").isNotNull())
    lo = vals.agg(F.min("_x")).scalar()
    hi = vals.agg(F.max("_x")).scalar()
    width = hi - lo
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - lo) * F.lit(bins) / width), F.lit(bins - 1))).cast("int")
    g = vals.select(b.alias("bin"), lo.alias("_lo"), width.alias("_w")).groupBy("bin", "_lo", "_w").agg(
        F.count(F.lit(1)).alias("count"))
    return g.select("bin", (F.col("_lo") + F.col("_w") * F.col("bin") / bins).alias("bin_lo"),
                    (F.col("_lo") + F.col("_w") * (F.col("bin") + 1) / bins).alias("bin_hi"), "count")


def query_counts_per_db(df: DataFrame, db_col: str = "db_id", thin: int = 10, cap: int = 50) -> DataFrame:
    """Queries per database, most first, with thin-data and cap flags."""
    g = df.groupBy(db_col).agg(F.count(F.lit(1)).alias("n_queries"))
    return g.select(db_col, "n_queries", (F.col("n_queries") < thin).cast("int").alias("thin_data"),
                    (F.col("n_queries") >= cap).cast("int").alias("at_cap")).orderBy(F.desc("n_queries"), db_col)


def pred_vs_actual(scored: DataFrame, dbs: Sequence[str] | None = None, db_col: str = "db_id",
                   y_log: str = "log_runtime", p_log: str = "pred_log", key: str = "question_id",
                   y_s: str | None = None, p_s: str | None = None) -> DataFrame:
    """Predicted vs actual on the log scale and in seconds (seconds
    columns are used when given, else exp of the logs)."""
    s = scored if not dbs else scored.where(F.col(db_col).isin(list(dbs)))
    ys = F.col(y_s) if y_s else F.exp(y_log)
    ps = F.col(p_s) if p_s else F.exp(p_log)
    return s.select(key, db_col, F.col(y_log).alias("actual_log"), F.col(p_log).alias("pred_log"),
                    ys.alias("actual_s"), ps.alias("pred_s"))


def coverage_vs_r2(best: DataFrame, stats: DataFrame, db_col: str = "db_id") -> DataFrame:
    """Best model per database with index coverage and log10(rows + 1)."""
    j = best.join(stats, db_col, "left")
    return j.select(db_col, "model", "r2_log", "schema_index_coverage",
                    F.log10(F.col("schema_total_rows").cast("double") + 1).alias("log10_rows"))


def top_features(importance: DataFrame, k: int = 10) -> DataFrame:
    """The k largest importances (top-k is the feature)."""
    return importance.orderBy(F.desc("importance"), "feature").limit(k)


def head_preview(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """First n rows (by ``order_by``) with every value as text, null -> ''."""
    top = df.orderBy(*order_by).limit(n)
    return top.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def slow_percent_range(df: DataFrame, split_col: str = "split", db_col: str = "db_id",
                       label_binary: str = "label_binary", runtime: str = "runtime_s") -> DataFrame:
    """Per database n, n_train, n_test, truncated slow percentage and
    min / max / mean runtime."""
    return df.groupBy(db_col).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(split_col) == "train").alias("n_train"),
        F.count_if(F.col(split_col) == "test").alias("n_test"),
        F.floor(F.avg(F.col(label_binary).cast("double")) * 100).cast("long").alias("slow_pct"),
        F.min(runtime).alias("min_runtime_s"), F.max(runtime).alias("max_runtime_s"),
        F.avg(runtime).alias("mean_runtime_s"))
