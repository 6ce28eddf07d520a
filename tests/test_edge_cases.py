"""Hand-made edge cases for the SQL-text features, labels, tiers and metrics."""

import math

import pytest
from pyspark.sql import functions as F

from querylens.functions import sqltext as st
from querylens.operators import labels as lb
from querylens.operators import metrics as me
from querylens.operators import querylog as ql


def _feats(spark, sql):
    df = spark.createDataFrame([(1, "db", "x", sql)], "question_id int, db_id string, difficulty string, sql string")
    return st.add_parsed_features(df).first().asDict()


def test_newline_join_not_counted(spark):
    f = _feats(spark, "SELECT a\nJOIN b ON x = y JOIN c ON 1=1")
    assert f["n_joins"] == 1 and f["n_tables_approx"] == 2


def test_empty_sql_gives_nulls(spark):
    f = _feats(spark, "")
    assert all(f[c] is None for c in st.FEATURE_COLUMNS)


def test_unbalanced_parentheses(spark):
    assert _feats(spark, "))((")["max_nesting_depth"] == 0
    assert _feats(spark, "(()")["max_nesting_depth"] == 2
    assert _feats(spark, "a)(b(c))")["max_nesting_depth"] == 1


def test_where_part_and_substring_semantics(spark):
    f = _feats(spark, "select x from t where a = 1 and b = 2 or c = 3 group by x")
    assert f["n_where_predicates"] == 3
    assert f["has_group_by"] == 1
    f = _feats(spark, "SELECT MYCOUNT(x), count (y) FROM t")
    assert f["n_count"] == 1 and f["n_aggregations"] == 1


def test_strip_and_dialect(spark):
    df = spark.createDataFrame([("  select `a` from t limit 5, 10;; \n",)], "sql string")
    r = df.select(st.strip_sql("sql").alias("s"), st.normalize_dialect("sql").alias("d")).first()
    assert r["s"] == "select `a` from t limit 5, 10"
    assert r["d"] == "select a from t LIMIT 10 OFFSET 5"


def test_quantile_label_ties(spark):
    # p50 == p75: slow wins
    df = spark.createDataFrame([(i, 1.0) for i in range(5)] + [(9, 0.5)], "question_id int, runtime_s double")
    out = {r["question_id"]: r["label"] for r in lb.label_quantile(df).collect()}
    assert out[0] == "slow" and out[9] == "fast"


def test_tier_boundary_value(spark):
    df = spark.createDataFrame([(i, "d", float(i)) for i in range(1, 11)], "question_id int, db_id string, runtime_s double")
    cut = lb.cutoff_table(df, quantiles=[0.5], labels=["lo", "hi"])
    th = cut.first()["threshold_s"]
    assert th == pytest.approx(5.5)
    t = lb.tier_label(df.union(spark.createDataFrame([(99, "d", 5.5)], df.schema)), cut, labels=["lo", "hi"])
    got = {r["question_id"]: r["tier_label"] for r in t.collect()}
    assert got[99] == "lo" and got[6] == "hi" and got[5] == "lo"


def test_validate_cutoffs():
    with pytest.raises(ValueError):
        lb.validate_cutoffs([0.5, 0.4], ["a", "b", "c"])
    with pytest.raises(ValueError):
        lb.validate_cutoffs([0.5], ["a"])
    assert lb.validate_cutoffs([0.2, 0.8], ["a", "b", "c"])[0] == [0.2, 0.8]


def test_one_class_group_metrics_are_null(spark):
    df = spark.createDataFrame([("a", 1, 1, 0.9), ("a", 1, 0, 0.2), ("b", 0, 1, 0.6), ("b", 1, 1, 0.7)],
                               "db_id string, y_true int, y_pred int, y_proba double")
    m = {r["db_id"]: r for r in me.binary_metrics(df, ["db_id"], safe=True).collect()}
    assert m["a"]["f1"] is None and m["b"]["f1"] is not None
    auc = {r["db_id"]: r["roc_auc"] for r in me.roc_auc(df, ["db_id"]).collect()}
    assert auc["a"] is None and auc["b"] == pytest.approx(1.0)


def test_auc_ties_and_monotone_invariance(spark):
    rows = [(1, 0.5), (0, 0.5), (1, 0.8), (0, 0.1), (1, 0.5), (0, 0.9)]
    df = spark.createDataFrame(rows, "y_true int, y_proba double")
    a = me.roc_auc(df).first()["roc_auc"]
    # brute force with tie = 1/2
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    brute = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert a == pytest.approx(brute)
    b = me.roc_auc(df.withColumn("y_proba", F.exp(F.col("y_proba") * 3))).first()["roc_auc"]
    assert b == pytest.approx(a)


def test_history_metrics_small_groups(spark):
    df = spark.createDataFrame([("a", 0.1, 0.2), ("b", 0.1, 0.1), ("b", 0.1, 0.3)],
                               "database string, runtime_s double, predicted_runtime_s double")
    m = {r["database"]: r for r in me.history_metrics(df, ["database"]).collect()}
    assert m["a"]["r2"] is None and m["a"]["mae_ms"] is None  # one row
    assert m["b"]["r2"] is None and m["b"]["mae_ms"] == pytest.approx(100.0)  # constant target


def test_error_categories(spark):
    msgs = ["Query timeout > 30s", "no such column: x", 'near "FROM": syntax error', "disk I/O", "interrupted"]
    df = spark.createDataFrame([(m,) for m in msgs], "m string")
    got = [r[0] for r in df.select(ql.categorize_error("m")).collect()]
    assert got == ["timeout", "missing object", "syntax error", "other", "timeout"]


def test_quality_band(spark):
    df = spark.createDataFrame([(0.8,), (0.5,), (0.1,), (-1.0,), (None,)], "r double")
    got = [r[0] for r in df.select(me.quality_band("r")).collect()]
    assert got == ["strong", "moderate", "weak", "negative", "not enough data"]
    assert not math.isnan(0.0)


def test_feature_columns_selection(spark):
    df = spark.createDataFrame([(1, "d", 2, 3, "x")], "question_id int, db_id string, n_joins int, extra int, sql string")
    assert ql.feature_columns(df) == ["n_joins", "extra"]
    assert ql.feature_columns(df, ["n_joins", "missing"]) == ["n_joins"]


def test_wilcoxon_statistic_and_exact_p(spark):
    rows = [("a", f, v) for f, v in enumerate([0.9, 0.8, 0.85, 0.7, 0.95])] + \
           [("b", f, v) for f, v in enumerate([0.6, 0.82, 0.5, 0.65, 0.9])]
    df = spark.createDataFrame(rows, "model string, fold int, f1 double")
    r = me.wilcoxon_top_two(df).first()
    # d = 0.3, -0.02, 0.35, 0.05, 0.05 -> ranks 4, 1, 5, 2.5, 2.5 -> W- = 1
    assert r["model_a"] == "a" and r["n"] == 5 and r["statistic"] == pytest.approx(1.0)
    assert 2 * me.signed_rank_cdf(4)[0] == pytest.approx(2 / 16)


def _paired(diffs):
    rows = [("a", f, 10.0 + d) for f, d in enumerate(diffs)] + [("b", f, 10.0) for f, _ in enumerate(diffs)]
    return rows


def test_wilcoxon_p_values(spark):
    import itertools
    diffs = [5.0, -1.0, 4.0, 3.0, 2.0, 7.0, -6.0]
    df = spark.createDataFrame(_paired(diffs), "model string, fold int, f1 double")
    r = me.wilcoxon_top_two(df).first()
    sums = [sum(rank for rank, up in zip(range(1, 8), signs) if up) for signs in itertools.product([0, 1], repeat=7)]
    share = sum(min(w, 28 - w) <= r["statistic"] for w in sums) / 2 ** 7
    assert r["p_value"] == pytest.approx(share)
    # more pairs than the exact table holds, and ties: normal approximation
    many = [float(i % 9 + 1) * (1 if i % 4 else -1) for i in range(40)]
    r = me.wilcoxon_top_two(spark.createDataFrame(_paired(many), "model string, fold int, f1 double")).first()
    n, ties = 40, [sum(abs(x) == v for x in many) for v in {abs(x) for x in many}]
    var = n * (n + 1) * (2 * n + 1) / 24 - sum(t ** 3 - t for t in ties) / 48
    z = abs(r["statistic"] - n * (n + 1) / 4) / math.sqrt(var)
    assert r["n"] == 40 and r["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-6)


def test_plan_reachability_rules(spark):
    from querylens.plans.plan_tree import reachable_nodes
    rows = [
        (1, 2, 0), (1, 5, 2), (1, 9, 7),          # 9 hangs under a missing non-zero parent: dropped
        (2, 0, None), (2, 3, 0),                 # node 0 exists: 3 is its child, 0 is top (null parent)
        (3, 4, 6), (3, 6, 4),                    # no top-level node: smallest id (4) is the root
    ]
    df = spark.createDataFrame(rows, "query_id long, node_id int, parent_id int")
    got = {(r["query_id"], r["node_id"]): r["depth"] for r in reachable_nodes(df).collect()}
    assert got[(1, 2)] == 1 and got[(1, 5)] == 2 and (1, 9) not in got
    assert got[(2, 0)] == 1 and got[(2, 3)] == 2
    assert got[(3, 4)] == 1 and got[(3, 6)] == 2 and len([k for k in got if k[0] == 3]) == 2
