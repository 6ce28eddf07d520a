"""Label, quantile and tier queries."""

from __future__ import annotations

from ..operators import labels as lb
from ..registry import register
from ..sources import fixtures as fx
from .common import d6, r6

_LAB = """q AS (SELECT quantile_cont(runtime_s, 0.5) AS p50, quantile_cont(runtime_s, 0.75) AS p75 FROM query_log),
lab AS (SELECT l.*, CASE WHEN runtime_s >= p75 THEN 'slow' WHEN runtime_s <= p50 THEN 'fast' ELSE 'mid' END AS label
        FROM query_log l, q),
kept AS (SELECT *, CASE WHEN label = 'slow' THEN 1 ELSE 0 END AS label_binary FROM lab WHERE label <> 'mid')
"""


def _ctes(*names):
    from ..sources.fixtures import DUCKDB_CTES
    return "WITH " + ",\n".join(f"{n} AS ({DUCKDB_CTES[n]})" for n in names) + ",\n"


register("l2_label_quantile", _ctes("query_log") + _LAB +
         "SELECT question_id, db_id, label, label_binary FROM kept")(
    lambda spark, sf: lb.label_quantile(fx.query_log(spark, sf)).select("question_id", "db_id", "label", "label_binary"))

register("l12_label_skew", _ctes("query_log") + _LAB + """
SELECT db_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE label_binary = 0)::BIGINT AS fast,
  count(*) FILTER (WHERE label_binary = 1)::BIGINT AS slow, """ + d6("avg(label_binary) * 100.0") + """ AS pct_slow,
  """ + d6("avg(label_binary)") + """ AS slow_rate,
  CASE WHEN avg(label_binary) <= 0 OR avg(label_binary) >= 1 THEN 1 ELSE 0 END AS degenerate
FROM kept GROUP BY db_id""")(
    lambda spark, sf: lb.label_skew(lb.label_quantile(fx.query_log(spark, sf))).select(
        "db_id", "n", "fast", "slow", r6("pct_slow").alias("pct_slow"), r6("slow_rate").alias("slow_rate"), "degenerate"))

from pyspark.sql import functions as F  # noqa: E402

from .common import with_ctes  # noqa: E402


def _l1(spark, sf):
    q = lb.quantile_table(fx.query_log(spark, sf), "runtime_s", [0.25, 0.5, 0.75], ["db_id"])
    return q.select("db_id", "n", *[r6(F.col("quantiles")[i]).alias(f"q{k}") for i, k in enumerate((25, 50, 75))])


register("l1_quantiles_per_db", with_ctes(
    "SELECT db_id, count(runtime_s)::BIGINT AS n, " + ", ".join(
        d6(f"quantile_cont(runtime_s, {q})") + f" AS q{k}" for q, k in ((0.25, 25), (0.5, 50), (0.75, 75)))
    + " FROM query_log GROUP BY db_id", "query_log"))(_l1)

register("l3_label_median", with_ctes(
    """SELECT question_id, CASE WHEN runtime_s >= (SELECT median(runtime_s) FROM query_log) THEN 'slow' ELSE 'fast' END AS label
       FROM query_log""", "query_log"))(
    lambda spark, sf: lb.label_median(fx.query_log(spark, sf)).select("question_id", "label"))

register("l5_label_threshold", with_ctes(
    """SELECT id, CASE WHEN had_error = 1 OR runtime_s IS NULL THEN NULL WHEN runtime_s >= 0.05 THEN 'slow' ELSE 'fast' END
         AS actual_label FROM history""", "history"))(
    lambda spark, sf: fx.history(spark, sf).select(
        "id", lb.threshold_label(F.col("runtime_s"), F.col("had_error")).alias("actual_label")))

register("l6_class_distribution", with_ctes(
    """SELECT label, cnt::BIGINT AS count, """ + d6("round_even(cnt * 100.0 / sum(cnt) OVER (), 2)") + """ AS percentage FROM (
         SELECT 'fast' AS label, count(*) FILTER (WHERE runtime_s <= p50) AS cnt FROM query_log, q GROUP BY p50
         UNION ALL SELECT 'mid', count(*) FILTER (WHERE runtime_s > p50 AND runtime_s < p75) FROM query_log, q GROUP BY p50, p75
         UNION ALL SELECT 'slow', count(*) FILTER (WHERE runtime_s >= p75) FROM query_log, q GROUP BY p75)""",
    "query_log", extra=[("q", "SELECT quantile_cont(runtime_s, 0.5) AS p50, quantile_cont(runtime_s, 0.75) AS p75 FROM query_log")]))(
    lambda spark, sf: lb.class_distribution(fx.query_log(spark, sf)).select(
        "label", "count", r6("percentage").alias("percentage")))

register("l7_label_counts", _ctes("query_log") + _LAB +
         "SELECT db_id, label, count(*)::BIGINT AS n FROM kept GROUP BY db_id, label")(
    lambda spark, sf: lb.label_counts(lb.label_quantile(fx.query_log(spark, sf)), "db_id"))

_TIER_Q = [0.2, 0.4, 0.6, 0.8]
register("l9_calibrate_thresholds", with_ctes(
    " UNION ALL ".join(f"SELECT {i} AS level, " + d6(f"quantile_cont(runtime_s, {q})") + " AS threshold_s FROM query_log"
                       for i, q in enumerate(_TIER_Q)), "query_log"))(
    lambda spark, sf: lb.calibrate_thresholds(fx.query_log(spark, sf)).select(
        F.posexplode("thresholds").alias("level", "threshold_s")).select(
        F.col("level").cast("int").alias("level"), r6("threshold_s").alias("threshold_s")))

_PERDB_TH = ("SELECT db_id, count(runtime_s) AS n, " + ", ".join(
    f"quantile_cont(runtime_s, {q}) AS t{i}" for i, q in enumerate(_TIER_Q)) + " FROM query_log GROUP BY db_id")
_GLOB_TH = ("SELECT " + ", ".join(f"quantile_cont(runtime_s, {q}) AS t{i}" for i, q in enumerate(_TIER_Q))
            + " FROM query_log")

register("l10_cutoff_table", with_ctes(
    " UNION ALL ".join(f"SELECT CAST(NULL AS VARCHAR) AS db_id, {i} AS level, " + d6(f"t{i}") + " AS threshold_s FROM g"
                       for i in range(4)) + " UNION ALL " +
    " UNION ALL ".join(f"SELECT db_id, {i} AS level, " + d6(f"t{i}") + " AS threshold_s FROM p WHERE n >= 20"
                       for i in range(4)),
    "query_log", extra=[("g", _GLOB_TH), ("p", _PERDB_TH)]))(
    lambda spark, sf: lb.cutoff_table(fx.query_log(spark, sf), policy="per_db_quantile").select(
        "db_id", "level", r6("threshold_s").alias("threshold_s")))


def _l11(spark, sf):
    log = fx.query_log(spark, sf)
    cut = lb.cutoff_table(log, policy="per_db_quantile")
    return lb.tier_label(log, cut, policy="per_db_quantile").select(
        "question_id", "tier_label", "tier_index", "threshold_source")


_TIER_IDX = " + ".join(f"CAST(runtime_s > coalesce(p.t{i}, g.t{i}) AS INTEGER)" for i in range(4))
register("l11_tier_label", with_ctes(
    f"""SELECT question_id, ['very_fast', 'fast', 'medium', 'slow', 'very_slow'][{_TIER_IDX} + 1] AS tier_label,
          {_TIER_IDX} AS tier_index,
          CASE WHEN p.db_id IS NOT NULL THEN 'per_db' ELSE 'global' END AS threshold_source
        FROM query_log l CROSS JOIN g LEFT JOIN (SELECT * FROM p WHERE n >= 20) p ON l.db_id = p.db_id""",
    "query_log", extra=[("g", _GLOB_TH), ("p", _PERDB_TH)]))(_l11)


# Cut-offs taken from the log itself, kept where they make tiers
def _l8(spark, sf):
    """Which databases' quantiles give valid tiers, cut-offs as shares of the
    largest runtime (equal or out-of-range cut-offs make none)."""
    log = fx.query_log(spark, sf)
    top = log.groupBy("db_id").agg(F.max("runtime_s").alias("top"))
    q = lb.quantile_table(log, "runtime_s", [0.2, 0.4, 0.6, 0.8], ["db_id"]).join(top, "db_id")
    shares = F.transform("quantiles", lambda x: x / F.col("top"))
    return q.select("db_id", lb.valid_cutoffs(shares, F.lit(5)).alias("valid"), lb.valid_cutoffs(shares, F.lit(4)).alias("valid_four_labels"))


_EDGES = [f"quantile_cont(runtime_s, {q}) / max(runtime_s)" for q in (0.2, 0.4, 0.6, 0.8)]
_RISE = " AND ".join(f"{a} < {b}" for a, b in zip(["0", *_EDGES], [*_EDGES, "1"]))
register("l8_valid_cutoffs", with_ctes(
    f"SELECT db_id, {_RISE} AS valid, false AS valid_four_labels FROM query_log GROUP BY db_id", "query_log"))(_l8)
