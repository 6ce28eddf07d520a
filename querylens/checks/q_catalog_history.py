"""Catalog (C1-C6) and history (H1-H8) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as ca
from ..operators import history as hi
from ..operators import querylog as ql
from ..registry import register
from ..sources import fixtures as fx
from ..sources.tables import TABLES, read_table
from .common import d6, r6, with_ctes

_STATS = """SELECT db_id, count(*)::BIGINT AS schema_n_tables, coalesce(sum(row_count), 0)::BIGINT AS schema_total_rows,
  coalesce(max(row_count), 0)::BIGINT AS schema_max_table_rows, coalesce(sum(n_indexes), 0)::BIGINT AS schema_total_indexes,
  coalesce(avg(CASE WHEN n_indexes > 0 THEN 1.0 ELSE 0.0 END), 0.0) AS schema_index_coverage,
  ln(1 + coalesce(sum(row_count), 0)) AS schema_log_total_rows FROM catalog_tables GROUP BY db_id"""


def _stats(spark, sf):
    return ca.schema_stats(fx.catalog_tables(spark, sf))


register("c1_schema_stats", with_ctes(
    f"""SELECT db_id, schema_n_tables, schema_total_rows, schema_max_table_rows, schema_total_indexes,
          {d6('schema_index_coverage')} AS schema_index_coverage, {d6('schema_log_total_rows')} AS schema_log_total_rows FROM s""",
    "catalog_tables", extra=[("s", _STATS)]))(
    lambda spark, sf: _stats(spark, sf).select(
        "db_id", *[F.col(c).cast("long").alias(c) for c in ca.SCHEMA_FEATURES[:4]],
        r6("schema_index_coverage").alias("schema_index_coverage"), r6("schema_log_total_rows").alias("schema_log_total_rows")))

register("c2_table_row_counts",
         " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*)::BIGINT AS row_count FROM {t}" for t in TABLES))(
    lambda spark, sf: ca.table_row_counts(spark, {t: read_table(spark, sf, t) for t in TABLES}))

register("c3_inspect_schema")(
    lambda spark, sf: ca.inspect_schema(spark, "driver", {t: read_table(spark, sf, t) for t in TABLES},
                                        primary_keys={"orders": ["o_orderkey"], "customer": ["c_custkey"]}))

register("c4_join_catalog", with_ctes(
    f"""SELECT question_id, l.db_id, schema_n_tables, schema_total_rows, {d6('schema_index_coverage')} AS schema_index_coverage
        FROM query_log l LEFT JOIN s ON l.db_id = s.db_id""", "query_log", "catalog_tables", extra=[("s", _STATS)]))(
    lambda spark, sf: ca.join_catalog(fx.query_log(spark, sf), _stats(spark, sf)).select(
        "question_id", "db_id", F.col("schema_n_tables").cast("long").alias("schema_n_tables"),
        F.col("schema_total_rows").cast("long").alias("schema_total_rows"),
        r6("schema_index_coverage").alias("schema_index_coverage")))

_C5_COLS = ["c_mktsegment", "c_nationkey", "c_name"]
register("c5_value_samples",
         "SELECT col_name, (rn // step)::BIGINT AS sample_pos, value FROM ("
         "SELECT *, greatest(1, least(n, 40) // 8) AS step FROM ("
         "SELECT col_name, value, row_number() OVER (PARTITION BY col_name ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY col_name) AS n FROM ("
         + " UNION ".join(f"SELECT DISTINCT '{c}' AS col_name, CAST({c} AS VARCHAR) AS value FROM customer WHERE {c} IS NOT NULL" for c in _C5_COLS)
         + "))) WHERE rn < 40 AND rn % step = 0 AND rn // step < 8")(
    lambda spark, sf: ca.value_samples(read_table(spark, sf, "customer"), _C5_COLS))

_C6_COLS = ["l_quantity", "l_discount", "l_extendedprice"]
register("c6_five_point",
         "SELECT col_name, " + ", ".join(
             f"max(CASE WHEN rn = least(n - 1, CAST(floor({q} * (n - 1)) AS BIGINT)) THEN v END) AS {lab}"
             for q, lab in zip([0.0, 0.25, 0.5, 0.75, 1.0], ["p0", "p25", "p50", "p75", "p100"]))
         + " FROM (SELECT col_name, v, row_number() OVER (PARTITION BY col_name ORDER BY v) - 1 AS rn, count(*) OVER (PARTITION BY col_name) AS n FROM ("
         + " UNION ALL ".join(f"SELECT '{c}' AS col_name, CAST({c} AS DOUBLE) AS v FROM lineitem WHERE {c} IS NOT NULL" for c in _C6_COLS)
         + ")) GROUP BY col_name")(
    lambda spark, sf: ca.five_point(read_table(spark, sf, "lineitem"), _C6_COLS))


def _hist(spark, sf):
    return hi.append_history(None, fx.history(spark, sf), ts_col="ts")


_LABEL_SQL = "CASE WHEN had_error = 1 OR runtime_s IS NULL THEN NULL WHEN runtime_s >= 0.05 THEN 'slow' ELSE 'fast' END"

register("h1_append_history", with_ctes(
    f"SELECT id, {_LABEL_SQL} AS actual_label, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM history", "history"))(
    lambda spark, sf: _hist(spark, sf).select("id", "actual_label", "timestamp"))

register("h2_history_newest_first", with_ctes("SELECT id, database FROM history ORDER BY id DESC", "history"))(
    lambda spark, sf: hi.history_newest_first(_hist(spark, sf)).select("id", "database"))

register("h3_history_for_metrics", with_ctes(
    f"""SELECT id, {d6('runtime_s')} AS runtime_s, {d6('predicted_runtime_s')} AS predicted_runtime_s, {_LABEL_SQL} AS actual_label
        FROM history WHERE had_error = 0 AND runtime_s IS NOT NULL AND predicted_runtime_s IS NOT NULL ORDER BY id""", "history"))(
    lambda spark, sf: hi.history_for_metrics(_hist(spark, sf)).select(
        "id", r6("runtime_s").alias("runtime_s"), r6("predicted_runtime_s").alias("predicted_runtime_s"), "actual_label"))

register("h4_history_counts", with_ctes(
    """SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE had_error <> 0)::BIGINT AS errors,
         count(*) FILTER (WHERE had_error = 0 AND runtime_s IS NOT NULL AND predicted_runtime_s IS NOT NULL)::BIGINT AS valid,
         count(*) FILTER (WHERE had_error = 0 AND runtime_s IS NOT NULL)::BIGINT AS trainable FROM history""", "history"))(
    lambda spark, sf: hi.history_counts(_hist(spark, sf)))

register("h5_history_by_database", with_ctes(
    f"""SELECT database, count(id)::BIGINT AS queries, {d6('avg(runtime_s) * 1000')} AS avg_actual_ms,
          {d6('avg(predicted_runtime_s) * 1000')} AS avg_predicted_ms FROM history GROUP BY database""", "history"))(
    lambda spark, sf: hi.history_by_database(_hist(spark, sf)).select(
        "database", "queries", r6("avg_actual_ms").alias("avg_actual_ms"), r6("avg_predicted_ms").alias("avg_predicted_ms")))

register("h6_evolve_history_schema", with_ctes(
    """SELECT id, CAST(NULL AS VARCHAR) AS timestamp, CAST(NULL AS BIGINT) AS row_count, CAST(NULL AS VARCHAR) AS predicted_label,
         CAST(NULL AS VARCHAR) AS actual_label, had_error FROM history""", "history"))(
    lambda spark, sf: hi.evolve_history_schema(fx.history(spark, sf)).select(
        "id", "timestamp", "row_count", "predicted_label", "actual_label", "had_error"))

_H7 = [("m0", """SELECT CAST(question_id AS VARCHAR) AS question_id, runtime_s FROM query_log
                 UNION ALL SELECT concat('history_', CAST(id AS VARCHAR)), runtime_s FROM history
                   WHERE had_error = 0 AND runtime_s IS NOT NULL AND runtime_s > 0"""),
       ("m", "SELECT * FROM m0 WHERE runtime_s > 0"),
       ("mq", "SELECT quantile_cont(runtime_s, 0.5) AS p50, quantile_cont(runtime_s, 0.75) AS p75 FROM m")]

register("h7_merge_history_into_training", with_ctes(
    f"""SELECT question_id, label, CASE WHEN label = 'slow' THEN 1 ELSE 0 END AS label_binary, {d6('ln(runtime_s)')} AS log_runtime
        FROM (SELECT m.*, CASE WHEN runtime_s >= p75 THEN 'slow' WHEN runtime_s <= p50 THEN 'fast' ELSE 'mid' END AS label FROM m, mq)
        WHERE label <> 'mid'""", "query_log", "history", "catalog_tables", extra=_H7))(
    lambda spark, sf: hi.merge_history_into_training(fx.query_log(spark, sf), fx.history(spark, sf), _stats(spark, sf)).select(
        "question_id", "label", "label_binary", r6("log_runtime").alias("log_runtime")))


def _h8(spark, sf):
    log = fx.query_log(spark, sf)
    med = ql.median_runtime(fx.run_log(spark, sf))
    fresh = med.join(log.select("question_id", "sql", "difficulty"), "question_id")
    out = hi.replace_subset(log, fresh, ["db_3", "db_5"])
    return out.select(F.col("question_id"), "db_id", r6("runtime_s").alias("runtime_s"), "label", "n_joins")


register("h8_replace_subset", with_ctes(
    f"""SELECT question_id, db_id, {d6('runtime_s')} AS runtime_s, label, n_joins FROM (
          SELECT m.*, CASE WHEN runtime_s >= p75 THEN 'slow' WHEN runtime_s <= p50 THEN 'fast' ELSE 'mid' END AS label
          FROM m, (SELECT quantile_cont(runtime_s, 0.5) AS p50, quantile_cont(runtime_s, 0.75) AS p75 FROM m))
        WHERE label <> 'mid'""", "query_log", "run_log", extra=[
        ("med", """SELECT question_id, db_id, median(elapsed_s) AS runtime_s FROM run_log GROUP BY question_id, db_id
                   HAVING count(*) FILTER (WHERE error IS NOT NULL OR elapsed_s IS NULL) = 0 AND count(elapsed_s) > 0"""),
        ("m0", """SELECT question_id, db_id, sql, runtime_s FROM query_log WHERE db_id NOT IN ('db_3', 'db_5')
                  UNION ALL SELECT med.question_id, med.db_id, l.sql, med.runtime_s FROM med JOIN query_log l ON med.question_id = l.question_id
                  WHERE med.db_id IN ('db_3', 'db_5')"""),
        ("m", """SELECT *, CASE WHEN sql IS NULL OR sql = '' THEN NULL ELSE
                   CAST((length(upper(sql)) - length(replace(upper(sql), ' JOIN ', ''))) / 6 AS INTEGER) END AS n_joins FROM m0""")]))(_h8)
