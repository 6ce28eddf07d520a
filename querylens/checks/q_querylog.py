"""Query-log preparation queries (Q1-Q12, K1, IO4-IO6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sqltext as st
from ..operators import labels as lb
from ..operators import querylog as ql
from ..registry import register
from ..sources import fixtures as fx
from .common import d6, features_sql_cte, r6, with_ctes

_DUCK_CATEGORY = """CASE WHEN contains(lower({m}), 'timeout') OR contains(lower({m}), 'interrupted') THEN 'timeout'
  WHEN contains(lower({m}), 'no such table') OR contains(lower({m}), 'no such column') THEN 'missing object'
  WHEN contains(lower({m}), 'syntax error') OR contains(lower({m}), 'near ') THEN 'syntax error' ELSE 'other' END"""

_OUTCOMES = [
    ("per_q", """SELECT question_id, db_id,
        arg_min(error, run_no) FILTER (WHERE error IS NOT NULL) AS first_err,
        count(*) FILTER (WHERE error IS NOT NULL OR elapsed_s IS NULL) AS n_fail,
        count(elapsed_s) AS n_ok FROM run_log GROUP BY question_id, db_id"""),
    ("dbs", "SELECT DISTINCT db_id AS kdb FROM catalog_tables"),
    ("oc", """SELECT p.question_id, p.db_id, (kdb IS NULL OR n_fail > 0 OR n_ok = 0) AS failed, kdb IS NULL AS missing,
        coalesce(first_err, 'no successful run') AS msg FROM per_q p LEFT JOIN dbs ON p.db_id = dbs.kdb"""),
    ("oc2", "SELECT *, CASE WHEN missing THEN 'missing database file' WHEN failed THEN "
            + _DUCK_CATEGORY.format(m="msg") + " END AS category FROM oc"),
    ("oc3", """SELECT *, CASE WHEN missing THEN 'missing database file' WHEN failed THEN concat(category, ': ', msg) END AS reason
        FROM oc2"""),
]


def _outcomes(spark, sf):
    return ql.question_outcomes(fx.run_log(spark, sf), fx.catalog_tables(spark, sf))


register("q1_strip_sql", with_ctes(
    "SELECT question_id, regexp_replace(regexp_replace(sql, '^\\s+|\\s+$', '', 'g'), ';+$', '') AS sql_stripped FROM query_log",
    "query_log"))(
    lambda spark, sf: fx.query_log(spark, sf).select("question_id", st.strip_sql("sql").alias("sql_stripped")))

_DUCK_DIALECT = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(replace(coalesce(sql, ''), '`', ''),
  'LIMIT\\s+(\\d+)\\s*,\\s*(\\d+)', 'LIMIT \\2 OFFSET \\1', 'gi'),
  '\\bNOW\\(\\)', 'datetime(''now'')', 'gi'),
  'GROUP_CONCAT\\s*\\((.*?)\\s+SEPARATOR\\s+.*?\\)', 'GROUP_CONCAT(\\1)', 'gis'),
  '\\s+COLLATE\\s+[A-Za-z0-9_]+', '', 'gi'),
  '^\\s+|\\s+$', '', 'g'), ';+$', ''), '\\s+$', ''), '^\\s+', '')"""

register("q2_normalize_dialect", with_ctes(
    f"SELECT question_id, {_DUCK_DIALECT} AS sql_sqlite FROM query_log", "query_log"))(
    lambda spark, sf: fx.query_log(spark, sf).select("question_id", st.normalize_dialect("sql").alias("sql_sqlite")))

register("q3_normalize_ws", with_ctes(
    "SELECT question_id, trim(regexp_replace(sql, '\\s+', ' ', 'g'), ' ') AS sql_ws FROM query_log", "query_log"))(
    lambda spark, sf: fx.query_log(spark, sf).select("question_id", st.normalize_ws("sql").alias("sql_ws")))


def _k1(spark, sf):
    q = fx.query_log(spark, sf)
    q = q.withColumn("qid", F.when(F.col("question_id") % 7 == 0, F.lit(None)).otherwise(F.col("question_id")))
    return q.select("question_id", st.query_key("db_id", "qid", "sql").alias("query_key"))


register("k1_query_key", with_ctes(
    """SELECT question_id, CASE WHEN qid IS NOT NULL AND trim(CAST(qid AS VARCHAR)) <> ''
         THEN concat(db_id, '::qid::', CAST(qid AS VARCHAR))
         ELSE concat(db_id, '::sql::', trim(regexp_replace(sql, '\\s+', ' ', 'g'), ' ')) END AS query_key
       FROM (SELECT *, CASE WHEN question_id % 7 = 0 THEN NULL ELSE question_id END AS qid FROM query_log)""",
    "query_log"))(_k1)

register("q4_median_runtime", with_ctes(
    "SELECT question_id, db_id, " + d6("median(elapsed_s)") + """ AS runtime_s, count(elapsed_s)::BIGINT AS n_runs
       FROM run_log GROUP BY question_id, db_id
       HAVING count(*) FILTER (WHERE error IS NOT NULL OR elapsed_s IS NULL) = 0 AND count(elapsed_s) > 0""",
    "run_log"))(
    lambda spark, sf: ql.median_runtime(fx.run_log(spark, sf)).select(
        "question_id", "db_id", r6("runtime_s").alias("runtime_s"), "n_runs"))

register("q5_categorize_error", with_ctes(
    "SELECT question_id, run_no, " + _DUCK_CATEGORY.format(m="error") + " AS category FROM run_log WHERE error IS NOT NULL",
    "run_log"))(
    lambda spark, sf: fx.run_log(spark, sf).where(F.col("error").isNotNull()).select(
        "question_id", "run_no", ql.categorize_error("error").alias("category")))

register("q6_failure_breakdown", with_ctes(
    "SELECT category, count(*)::BIGINT AS n_failures FROM oc3 WHERE failed GROUP BY category",
    "run_log", "catalog_tables", extra=_OUTCOMES))(
    lambda spark, sf: ql.failure_breakdown(_outcomes(spark, sf)))

register("q7_per_db_success", with_ctes(
    "SELECT db_id, count(*) FILTER (WHERE NOT failed)::BIGINT AS n_success, count(*)::BIGINT AS n_total FROM oc3 GROUP BY db_id",
    "run_log", "catalog_tables", extra=_OUTCOMES))(
    lambda spark, sf: ql.per_db_success(_outcomes(spark, sf)))

register("q8_sample_failures", with_ctes(
    "SELECT db_id, question_id, reason FROM oc3 WHERE failed ORDER BY question_id LIMIT 10",
    "run_log", "catalog_tables", extra=_OUTCOMES))(
    lambda spark, sf: ql.sample_failures(_outcomes(spark, sf)))

register("q9_positive_runtime", with_ctes(
    "SELECT question_id, " + d6("ln(runtime_s)") + " AS log_runtime FROM query_log WHERE runtime_s > 0", "query_log"))(
    lambda spark, sf: ql.positive_runtime(fx.query_log(spark, sf)).select("question_id", r6("log_runtime").alias("log_runtime")))

_FILL = st.FEATURE_COLUMNS + ["schema_n_tables"]
register("q10_fill_missing_features", with_ctes(
    "SELECT question_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in st.FEATURE_COLUMNS)
    + ", 0 AS schema_n_tables FROM feat", "query_log", extra=[("feat", features_sql_cte("query_log"))]))(
    lambda spark, sf: st.fill_missing_features(st.add_parsed_features(fx.query_log(spark, sf)), _FILL, keep=["question_id"]))

register("q11_exclude_dbs", with_ctes(
    "SELECT question_id, db_id FROM query_log WHERE db_id NOT IN ('db_0', 'db_1')", "query_log"))(
    lambda spark, sf: ql.subset_dbs(fx.query_log(spark, sf), ["db_0", "db_1"], exclude=True).select("question_id", "db_id"))


def _q12(spark, sf):
    log = fx.query_log(spark, sf).withColumn("query_key", st.query_key())
    keys = fx.predictions(spark, sf).where(F.col("y_true") == 1).select(st.query_key(sql=F.lit("")).alias("query_key"))
    return ql.subset_keys(log, keys).select("question_id", "query_key")


register("q12_subset_keys", with_ctes(
    """SELECT question_id, concat(db_id, '::qid::', CAST(question_id AS VARCHAR)) AS query_key FROM query_log
       WHERE concat(db_id, '::qid::', CAST(question_id AS VARCHAR)) IN
         (SELECT concat(db_id, '::qid::', CAST(question_id AS VARCHAR)) FROM predictions WHERE y_true = 1)""",
    "query_log", "predictions"))(_q12)


def _io4(spark, sf):
    labelled = lb.label_quantile(fx.query_log(spark, sf)).drop("label_binary")
    return ql.load_labelled_features(labelled).select("question_id", "label_binary", "query_key")


register("io4_load_labelled_features", with_ctes(
    """SELECT question_id, CASE WHEN label = 'slow' THEN 1 ELSE 0 END AS label_binary,
         concat(db_id, '::qid::', CAST(question_id AS VARCHAR)) AS query_key
       FROM (SELECT l.*, CASE WHEN runtime_s >= p75 THEN 'slow' WHEN runtime_s <= p50 THEN 'fast' ELSE 'mid' END AS label
             FROM query_log l, (SELECT quantile_cont(runtime_s, 0.5) p50, quantile_cont(runtime_s, 0.75) p75 FROM query_log))
       WHERE label <> 'mid'""", "query_log"))(_io4)


def _io5(spark, sf):
    h = fx.history(spark, sf).select("id", "database", F.col("runtime_s").alias("median_runtime_seconds"))
    return ql.read_runtime_log(h, fx.catalog_tables(spark, sf)).select("id", "database")


register("io5_read_runtime_log", with_ctes(
    """SELECT id, database FROM history WHERE runtime_s IS NOT NULL
       AND database IN (SELECT db_id FROM catalog_tables)""", "history", "catalog_tables"))(_io5)

register("io6_bird_plan_scan", with_ctes(
    """SELECT concat('bird_', CAST(question_id AS VARCHAR)) AS query_id, db_id AS database, sql AS query_text,
         CAST(NULL AS DOUBLE) AS target_runtime FROM query_log""", "query_log"))(
    lambda spark, sf: ql.bird_plan_scan(fx.query_log(spark, sf)))
