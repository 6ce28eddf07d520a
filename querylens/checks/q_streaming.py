"""Streaming queries (ST1-ST4): each stream is driven to completion over the
staged history files and its final table is compared with the batch oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as ca
from ..operators import labels as lb
from ..registry import register
from ..sources import fixtures as fx
from ..streaming import history_stream as hs
from .common import d6, r6, with_ctes


def _source(spark, sf):
    """The history as a stream of files, all there when the stream starts:
    they make one batch, whatever their order."""
    hist = fx.history(spark, sf)
    path = hs.stream_folder(spark, "history-src")
    hs.stage_history_files(hist, path)
    return hs.read_history_stream(spark, path, hist.schema, files_per_trigger=1_000_000)


def _st1(spark, sf):
    out = hs.run_to_table(hs.ingest(_source(spark, sf)), "ingest", output_mode="append")
    return out.select("id", "actual_label", "timestamp")


register("st1_stream_ingest", with_ctes(
    """SELECT id, CASE WHEN had_error = 1 OR runtime_s IS NULL THEN NULL WHEN runtime_s >= 0.05 THEN 'slow' ELSE 'fast' END AS actual_label,
         strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM history""", "history"))(_st1)


def _st2(spark, sf):
    state = hs.run_to_table(hs.running_moments(_source(spark, sf)), "moments", output_mode="update", key=["database"])
    whole = hs.counts_from_moments(state)
    per = state.select("database", "total", "errors", F.col("n").alias("valid"), "trainable").join(hs.databases_from_moments(state), "database")
    both = per.join(hs.metrics_from_moments(state), "database", "left")
    return both.select(
        "database", "total", "errors", "valid", "trainable", "queries", r6("avg_actual_ms").alias("avg_actual_ms"),
        r6("avg_predicted_ms").alias("avg_predicted_ms"), r6("r2").alias("r2"), r6("r2_log").alias("r2_log"), r6("mae_ms").alias("mae_ms"),
        *[whole.select(c).scalar().alias(f"all_{c}") for c in ("total", "errors", "valid", "trainable")])


_VALID = "had_error = 0 AND runtime_s IS NOT NULL AND predicted_runtime_s IS NOT NULL"
_COUNTS = (f"count(*)::BIGINT AS total, count(*) FILTER (WHERE had_error <> 0)::BIGINT AS errors, count(*) FILTER (WHERE {_VALID})::BIGINT AS valid, "
           "count(*) FILTER (WHERE had_error = 0 AND runtime_s IS NOT NULL)::BIGINT AS trainable")
register("st2_running_history_metrics", with_ctes(
    f"""SELECT c.*, {d6('c.mean_y * 1000')} AS avg_actual_ms, {d6('c.mean_p * 1000')} AS avg_predicted_ms, m.r2, m.r2_log, m.mae_ms,
          w.total AS all_total, w.errors AS all_errors, w.valid AS all_valid, w.trainable AS all_trainable
        FROM c LEFT JOIN m ON m.database = c.database CROSS JOIN w""".replace("c.*", "c.database, c.total, c.errors, c.valid, c.trainable, c.queries"),
    "history", extra=[
        ("c", f"SELECT database, {_COUNTS}, count(id)::BIGINT AS queries, avg(runtime_s) AS mean_y, avg(predicted_runtime_s) AS mean_p FROM history GROUP BY database"),
        ("w", f"SELECT {_COUNTS} FROM history"),
        ("m", "SELECT database, "
         + d6("CASE WHEN count(*) >= 2 AND var_pop(y) > 0 THEN 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END") + " AS r2, "
         + d6("CASE WHEN count(*) >= 2 AND var_pop(ly) > 0 THEN 1 - sum((ly - lp) * (ly - lp)) / (var_pop(ly) * count(*)) END") + " AS r2_log, "
         + d6("CASE WHEN count(*) >= 2 THEN avg(abs(y - p)) * 1000 END") + f""" AS mae_ms
         FROM (SELECT database, runtime_s AS y, predicted_runtime_s AS p, ln(1 + runtime_s) AS ly,
               ln(1 + greatest(predicted_runtime_s, 0)) AS lp FROM history WHERE {_VALID}) GROUP BY database""")]))(_st2)


def _st3(spark, sf):
    hist_rt = fx.history(spark, sf).select(F.col("database").alias("db_id"), "runtime_s")
    cut = lb.cutoff_table(hist_rt, policy="per_db_quantile")
    tiers = hs.tier_stream(_source(spark, sf), cut, lb.TIER_LABELS)
    return hs.run_to_table(tiers, "tiers", output_mode="append").where(F.col("runtime_s").isNotNull()).select(
        "id", "tier_label", "tier_index")


_TH = ("SELECT database, count(runtime_s) AS n, " + ", ".join(
    f"quantile_cont(runtime_s, {q}) AS t{i}" for i, q in enumerate(lb.TIER_QUANTILES)) + " FROM history GROUP BY database")
_GTH = "SELECT " + ", ".join(f"quantile_cont(runtime_s, {q}) AS t{i}" for i, q in enumerate(lb.TIER_QUANTILES)) + " FROM history"
_IDX = " + ".join(f"CAST(h.runtime_s > coalesce(p.t{i}, g.t{i}) AS INTEGER)" for i in range(4))
register("st3_stream_tiering", with_ctes(
    f"""SELECT h.id, ['very_fast', 'fast', 'medium', 'slow', 'very_slow'][{_IDX} + 1] AS tier_label, {_IDX} AS tier_index
        FROM history h CROSS JOIN g LEFT JOIN (SELECT * FROM p WHERE n >= 20) p ON h.database = p.database
        WHERE h.runtime_s IS NOT NULL""", "history", extra=[("p", _TH), ("g", _GTH)]))(_st3)


def _st4(spark, sf):
    stats = ca.schema_stats(fx.catalog_tables(spark, sf))
    path = hs.stream_folder(spark, "training-table")
    hs.incremental_training(_source(spark, sf), stats, path)
    return spark.read.parquet(path).select("question_id", "db_id", r6("runtime_s").alias("runtime_s"),
                                           F.col("schema_n_tables").cast("long").alias("schema_n_tables"))


register("st4_incremental_training", with_ctes(
    f"""SELECT concat('history_', CAST(id AS VARCHAR)) AS question_id, database AS db_id, {d6('runtime_s')} AS runtime_s,
          s.n::BIGINT AS schema_n_tables
        FROM history LEFT JOIN (SELECT db_id, count(*) AS n FROM catalog_tables GROUP BY db_id) s ON history.database = s.db_id
        WHERE had_error = 0 AND runtime_s IS NOT NULL AND runtime_s > 0""", "history", "catalog_tables"))(_st4)
