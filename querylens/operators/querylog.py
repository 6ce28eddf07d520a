"""Query-log preparation: run aggregation, failure reports, filters, keys.

All operators are projections, filters, grouped aggregates or semi/anti
joins.  Grouped aggregates use partial (map-side) aggregation, so a database
holding a third of the log only contributes partial buffers per task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import query_key


# The words of the error categories.
def categorize_error(msg) -> Column:
    """Q5: timeout / missing object / syntax error / other (first match wins)."""
    m = F.lower(F.col(msg) if isinstance(msg, str) else msg)
    return (F.when(m.contains("timeout") | m.contains("interrupted"), "timeout")
             .when(m.contains("no such table") | m.contains("no such column"), "missing object")
             .when(m.contains("syntax error") | m.contains("near "), "syntax error")
             .otherwise("other"))


def median_runtime(run_log: DataFrame, key_cols=("question_id", "db_id"),
                   elapsed: str = "elapsed_s", error: str = "error") -> DataFrame:
    """Q4: median of the runs per question; a question with any failed run
    (or no successful run) is dropped.  Groups hold one row per run, bounded
    by the configured run count, so an exact per-group median is cheap."""
    g = run_log.groupBy(*key_cols).agg(
        F.median(elapsed).alias("runtime_s"),
        F.count(elapsed).alias("n_runs"),
        F.count_if(F.col(error).isNotNull() | F.col(elapsed).isNull()).alias("_failed"))
    return g.where((F.col("_failed") == 0) & (F.col("n_runs") > 0)).drop("_failed")


def question_outcomes(run_log: DataFrame, known_dbs: DataFrame, db_col: str = "db_id") -> DataFrame:
    """One row per question: ``status`` ok / failed, failure ``category`` and
    ``reason``.  A question whose database is unknown fails with
    ``missing database file``; otherwise its first failed run decides (the
    reference stops at the first error)."""
    per_q = run_log.groupBy("question_id", db_col).agg(
        F.min_by(F.col("error"), F.when(F.col("error").isNotNull(), F.col("run_no"))).alias("_first_err"),
        F.count_if(F.col("error").isNotNull() | F.col("elapsed_s").isNull()).alias("_n_fail"),
        F.count("elapsed_s").alias("_n_ok"))
    dbs = known_dbs.select(F.col(db_col).alias("_kdb")).distinct()
    j = per_q.join(dbs, per_q[db_col] == dbs["_kdb"], "left")
    missing = F.col("_kdb").isNull()
    failed = missing | (F.col("_n_fail") > 0) | (F.col("_n_ok") == 0)
    msg = F.coalesce(F.col("_first_err"), F.lit("no successful run"))
    cat = F.when(missing, "missing database file").when(failed, categorize_error(msg))
    reason = F.when(missing, "missing database file").when(failed, F.concat(cat, F.lit(": "), msg))
    return j.select("question_id", db_col, F.when(failed, "failed").otherwise("ok").alias("status"),
                    cat.alias("category"), reason.alias("reason"))


def failure_breakdown(outcomes: DataFrame) -> DataFrame:
    """Q6: failures per category, most frequent first."""
    return (outcomes.where(F.col("status") == "failed").groupBy("category")
            .agg(F.count(F.lit(1)).alias("n_failures")).orderBy(F.desc("n_failures"), "category"))


def per_db_success(outcomes: DataFrame, db_col: str = "db_id") -> DataFrame:
    """Q7: successes and total per database."""
    return outcomes.groupBy(db_col).agg(F.count_if(F.col("status") == "ok").alias("n_success"),
                                        F.count(F.lit(1)).alias("n_total"))


def sample_failures(outcomes: DataFrame, n: int = 10) -> DataFrame:
    """Q8: the first ``n`` failures by question id (top-k is the feature)."""
    return (outcomes.where(F.col("status") == "failed").orderBy("question_id")
            .limit(n).select("db_id", "question_id", "reason"))


def positive_runtime(df: DataFrame, col: str = "runtime_s") -> DataFrame:
    """Q9: keep runtime > 0 and add ``log_runtime = ln(runtime)``."""
    return df.where(F.col(col) > 0).withColumn("log_runtime", F.ln(col))


def subset_dbs(df: DataFrame, dbs: Iterable[str], db_col: str = "db_id", exclude: bool = False) -> DataFrame:
    """Q11: keep (or drop) the listed databases; the list is a literal IN set."""
    cond = F.col(db_col).isin(list(dbs))
    return df.where(~cond if exclude else cond)


def subset_keys(df: DataFrame, keys: DataFrame, key_col: str = "query_key") -> DataFrame:
    """Q12: restrict to a key set with a left-semi join (the key table may be
    as large as the log, so no broadcast is forced; AQE broadcasts it when
    its measured size allows)."""
    return df.join(keys.select(key_col).distinct(), on=key_col, how="left_semi")


# Names never used as model features.
RESERVED = {"label", "label_binary", "db_id", "difficulty", "sql", "question_id", "runtime_s", "query_key"}


def feature_columns(df: DataFrame, configured: list[str] | None = None) -> list[str]:
    """Q13: configured feature list intersected with the schema; fallback is
    every column except the reserved ones."""
    cols = list(configured or [c for c in df.columns if c not in RESERVED])
    return [c for c in cols if c in df.columns]


def load_labelled_features(df: DataFrame) -> DataFrame:
    """IO4: derive ``label_binary`` from ``label`` when absent and add the query key."""
    if "label_binary" not in df.columns:
        if "label" not in df.columns:
            raise ValueError("no label_binary or label column")
        df = df.withColumn("label_binary", (F.lower(F.col("label").cast("string")) == "slow").cast("int"))
    if "db_id" not in df.columns:
        raise ValueError("no db_id column")
    return df.withColumn("query_key", query_key())


def read_runtime_log(df: DataFrame, known_dbs: DataFrame, runtime: str = "median_runtime_seconds",
                     db_col: str = "database") -> DataFrame:
    """IO5: rows with a runtime and a known database (left-semi join)."""
    dbs = known_dbs.select(F.col("db_id").alias(db_col)).distinct()
    return df.where(F.col(runtime).isNotNull()).join(dbs, on=db_col, how="left_semi")


def bird_plan_scan(questions: DataFrame) -> DataFrame:
    """IO6: plan-feature scan rows with id prefix ``bird_`` and a null target."""
    return questions.select(F.concat(F.lit("bird_"), F.col("question_id").cast("string")).alias("query_id"),
                            F.col("db_id").alias("database"), F.col("sql").alias("query_text"),
                            F.lit(None).cast("double").alias("target_runtime"))

