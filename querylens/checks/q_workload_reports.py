"""Workload shapes (W1-W13) and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as lb
from ..operators import metrics as me
from ..operators import reports as rp
from ..operators import splits as sp
from ..plans import workload as wl
from ..registry import register
from ..sources import fixtures as fx
from .common import d6, r6, with_ctes

_W_SQL = {
    "w1_count": "SELECT count(*)::BIGINT AS total_orders FROM orders",
    "w2_sorted_top": "SELECT c_custkey, c_name, c_nationkey FROM customer ORDER BY c_name, c_custkey LIMIT 10",
    "w3_join_group_top": """SELECT o.o_orderkey, any_value(o.o_orderdate) AS o_orderdate, count(l.l_orderkey)::BIGINT AS num_lines
        FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey ORDER BY num_lines DESC, o.o_orderkey LIMIT 5""",
    "w3b_customers_most_orders": """SELECT c.c_custkey, c.c_name, count(o.o_orderkey)::BIGINT AS num_orders
        FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey, c.c_name
        ORDER BY num_orders DESC, c.c_custkey LIMIT 10""",
    "w4_join_filter_group_top": """SELECT o.o_custkey, count(*)::BIGINT AS first_lines FROM orders o JOIN lineitem l
        ON o.o_orderkey = l.l_orderkey WHERE l.l_linenumber = 1 GROUP BY o.o_custkey ORDER BY first_lines DESC, o.o_custkey LIMIT 10""",
    "w5_three_way_avg_top": f"""SELECT n.n_nationkey, n.n_name, {d6('avg(o.o_totalprice)')} AS avg_price FROM nation n
        JOIN customer c ON n.n_nationkey = c.c_nationkey JOIN orders o ON c.c_custkey = o.o_custkey
        WHERE o.o_totalprice IS NOT NULL GROUP BY n.n_nationkey, n.n_name ORDER BY avg(o.o_totalprice) DESC, n.n_nationkey LIMIT 5""",
    "w6_join_in_sort_limit": """SELECT l.l_orderkey, l.l_extendedprice, o.o_orderstatus FROM lineitem l JOIN orders o
        ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus IN ('F', 'O')
        ORDER BY l.l_extendedprice DESC, l.l_orderkey, o.o_orderstatus LIMIT 10""",
    "w7_having": f"""SELECT c.c_custkey, c.c_mktsegment, count(*)::BIGINT AS n_orders, {d6('sum(o.o_totalprice)')} AS total_price
        FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey, c.c_mktsegment HAVING count(*) > 15""",
    "w8_distinct": "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer",
    "w9_union": "SELECT s_name AS name FROM supplier UNION SELECT c_name FROM customer",
    "w10_between": """SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus = 'O' OR o_custkey < 5""",
    "w11_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%red%'",
    "w12_exists": """SELECT c.c_custkey, c.c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o
        WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > (SELECT avg(o_totalprice) FROM orders))""",
    "w13_nested_scalar": f"""SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (
        SELECT avg(o_totalprice) FROM orders WHERE o_custkey IN (
          SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)))""",
}

_ROUND = {"w5_three_way_avg_top": ["avg_price"], "w7_having": ["total_price"]}


def _shape(name):
    fn = wl.SHAPES[name]
    cols = _ROUND.get(name, [])

    def q(spark, sf):
        df = fn(spark, sf)
        return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])
    return q


for _n, _sql in _W_SQL.items():
    register(_n, _sql)(_shape(_n))


def _r1(spark, sf):
    mc = me.model_comparison(fx.predictions(spark, sf))
    vals = ["test_accuracy", "test_precision", "test_recall", "test_f1", "test_roc_auc"]
    mc = mc.select("model", *[r6(c).alias(c) for c in vals])
    return rp.metrics_long(mc, ["model"], vals, "current", "all_models_test_comparison")


_R1_T = f"""SELECT model, {d6('(tp + tn)::DOUBLE / support')} AS test_accuracy,
    {d6('CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END')} AS test_precision,
    {d6('CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END')} AS test_recall,
    {d6('CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END')} AS test_f1 FROM (
    SELECT model, count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
      count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn,
      count(*) AS support FROM predictions GROUP BY model)"""
_R1_AUC = f"""SELECT model, {d6('(sum(pos * (cum - (pos + neg) + (pos + neg + 1) / 2)) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * sum(neg))')} AS test_roc_auc
    FROM (SELECT *, sum(pos + neg) OVER (PARTITION BY model ORDER BY y_proba ROWS UNBOUNDED PRECEDING) AS cum FROM (
      SELECT model, y_proba, count(*) FILTER (WHERE y_true = 1)::DOUBLE AS pos, count(*) FILTER (WHERE y_true = 0)::DOUBLE AS neg
      FROM predictions GROUP BY model, y_proba)) GROUP BY model"""

register("r1_metrics_long", with_ctes(
    """SELECT concat_ws('.', model, f) AS bundle_key, 'current' AS iteration, printf('%.6f', v) AS value,
         'all_models_test_comparison' AS source_file, f AS source_field, '' AS notes
       FROM (UNPIVOT (SELECT t.*, a.test_roc_auc FROM t JOIN a USING (model))
             ON test_accuracy, test_precision, test_recall, test_f1, test_roc_auc INTO NAME f VALUE v)""",
    "predictions", extra=[("t", _R1_T), ("a", _R1_AUC)]))(_r1)


def _hist_sql(expr: str, bins: int) -> str:
    return f"""SELECT bin, {d6(f'lo + w * bin / {bins}')} AS bin_lo, {d6(f'lo + w * (bin + 1) / {bins}')} AS bin_hi, count(*)::BIGINT AS count FROM (
      SELECT CAST(CASE WHEN w = 0 THEN 0 ELSE least(floor((x - lo) * {bins} / w), {bins - 1}) END AS INTEGER) AS bin, lo, w FROM (
        SELECT x, min(x) OVER () AS lo, max(x) OVER () - min(x) OVER () AS w FROM (SELECT {expr} AS x FROM query_log WHERE runtime_s IS NOT NULL)))
      GROUP BY bin, lo, w"""


def _hist(bins, log):
    def q(spark, sf):
        h = rp.runtime_histogram(fx.query_log(spark, sf), bins=bins, log=log)
        return h.select("bin", r6("bin_lo").alias("bin_lo"), r6("bin_hi").alias("bin_hi"), "count")
    return q


register("r2_runtime_histogram_30", with_ctes(_hist_sql("runtime_s", 30), "query_log"))(_hist(30, False))
register("r2_runtime_histogram_log40", with_ctes(_hist_sql("ln(runtime_s)", 40), "query_log"))(_hist(40, True))

register("r3_query_counts_per_db", with_ctes(
    """SELECT db_id, count(*)::BIGINT AS n_queries, CAST(count(*) < 10 AS INTEGER) AS thin_data, CAST(count(*) >= 50 AS INTEGER) AS at_cap
       FROM query_log GROUP BY db_id""", "query_log"))(
    lambda spark, sf: rp.query_counts_per_db(fx.query_log(spark, sf)))


def _r4(spark, sf):
    p = fx.predictions(spark, sf).select("question_id", "db_id", F.ln("runtime_s").alias("log_runtime"),
                                         F.ln("predicted_runtime_s").alias("pred_log"), "runtime_s", "predicted_runtime_s")
    out = rp.pred_vs_actual(p, ["db_0", "db_1"], y_s="runtime_s", p_s="predicted_runtime_s")
    return out.select("question_id", "db_id", *[r6(c).alias(c) for c in ["actual_log", "pred_log", "actual_s", "pred_s"]])


register("r4_pred_vs_actual", with_ctes(
    f"""SELECT question_id, db_id, {d6('ln(runtime_s)')} AS actual_log, {d6('ln(predicted_runtime_s)')} AS pred_log,
          {d6('runtime_s')} AS actual_s, {d6('predicted_runtime_s')} AS pred_s FROM predictions WHERE db_id IN ('db_0', 'db_1')""",
    "predictions"))(_r4)

register("r7_head_preview", with_ctes(
    """SELECT coalesce(CAST(question_id AS VARCHAR), '') AS question_id, coalesce(db_id, '') AS db_id,
         coalesce(difficulty, '') AS difficulty, coalesce(sql, '') AS sql
       FROM (SELECT * FROM query_log ORDER BY question_id LIMIT 5)""", "query_log"))(
    lambda spark, sf: rp.head_preview(fx.query_log(spark, sf).drop("runtime_s"), 5, ["question_id"]))

_KEPT = [("q", "SELECT quantile_cont(runtime_s, 0.5) AS p50, quantile_cont(runtime_s, 0.75) AS p75 FROM query_log"),
         ("kept", """SELECT * FROM (SELECT l.*, CASE WHEN runtime_s >= p75 THEN 1 WHEN runtime_s <= p50 THEN 0 ELSE NULL END AS label_binary
              FROM query_log l, q) WHERE label_binary IS NOT NULL""")]


def _r8(spark, sf):
    kept = lb.label_quantile(fx.query_log(spark, sf))
    out = rp.slow_percent_range(sp.split_within_group(kept))
    return out.select("db_id", "n", "n_train", "n_test", "slow_pct",
                      *[r6(c).alias(c) for c in ["min_runtime_s", "max_runtime_s", "mean_runtime_s"]])


register("r8_slow_percent_range", with_ctes(
    f"""SELECT db_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE rn >= t)::BIGINT AS n_train, count(*) FILTER (WHERE rn < t)::BIGINT AS n_test,
          CAST(floor(avg(label_binary) * 100) AS BIGINT) AS slow_pct, {d6('min(runtime_s)')} AS min_runtime_s,
          {d6('max(runtime_s)')} AS max_runtime_s, {d6('avg(runtime_s)')} AS mean_runtime_s
        FROM (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY md5(concat(CAST(question_id AS VARCHAR), '|', '42'))) - 1 AS rn,
                     CAST(ceil(0.2 * count(*) OVER (PARTITION BY db_id)) AS BIGINT) AS t FROM kept) GROUP BY db_id""",
    "query_log", extra=_KEPT))(_r8)
