"""Properties of the distributed building blocks and the fitted models."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from querylens.operators import linear as li
from querylens.operators import splits as sp
from querylens.operators.ranking import exact_quantiles, rank_within


def test_rank_within_equals_window(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 1000).cast("double").alias("v"))
    r = rank_within(df, ["g"], [F.col("v").asc()], sums=["v"], num_partitions=7)
    pdf = r.toPandas().sort_values(["g", "_rn"])
    for g, grp in pdf.groupby("g"):
        assert list(grp["_rn"]) == list(range(len(grp)))
        assert np.allclose(grp["_cum_v"].values, np.cumsum(np.sort(grp["v"].values)))
        assert (grp["_n"] == len(grp)).all()


def test_exact_quantiles_match_numpy(spark):
    vals = [float(x) for x in np.random.default_rng(0).normal(size=501)]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(vals)], "g int, v double")
    q = {r["g"]: r["quantiles"] for r in exact_quantiles(df, "v", [0.1, 0.5, 0.75], ["g"]).collect()}
    for g in (0, 1):
        ref = np.quantile([v for i, v in enumerate(vals) if i % 2 == g], [0.1, 0.5, 0.75])
        assert np.allclose(q[g], ref)


def test_gram_fit_equals_lstsq(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(400, 3)) * [1.0, 10.0, 0.1] + [5, -2, 0]
    y = X @ [0.5, -0.2, 3.0] + 1.0 + rng.normal(scale=0.1, size=400)
    df = spark.createDataFrame([tuple(map(float, r)) + (float(t),) for r, t in zip(X, y)], "a double, b double, c double, y double")
    fit = li.fit_linear_models(df, ["a", "b", "c"], "y", models={"Linear": ("ols", 0.0), "Ridge": ("ridge", 5.0)})
    coef = {r["model"]: r for r in fit.coefficients.collect()}
    A = np.column_stack([np.ones(len(X)), X])
    ref = np.linalg.lstsq(A, y, rcond=None)[0]
    assert coef["Linear"]["intercept"] == pytest.approx(ref[0], rel=1e-8)
    assert np.allclose(coef["Linear"]["coef"], ref[1:], rtol=1e-8)
    # ridge on standardized features, intercept unpenalised
    mu, sd = X.mean(0), X.std(0)
    Z = (X - mu) / sd
    w = np.linalg.solve(Z.T @ Z + 5.0 * np.eye(3), Z.T @ (y - y.mean()))
    assert np.allclose(coef["Ridge"]["coef"], w / sd, rtol=1e-8)


def test_one_feature_ridge_closed_form(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + (i % 3)) for i in range(50)], "x double, y double")
    fit = li.fit_linear_models(df, ["x"], "y", models={"R": ("ridge", 10.0)}).coefficients.first()
    cf = li.one_feature_closed_form(df, "x", "y", 10.0).first()
    assert fit["coef"][0] == pytest.approx(cf["slope"]) and fit["intercept"] == pytest.approx(cf["intercept"])


def test_lasso_zeroes_weak_features(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(300, 2))
    y = 3 * X[:, 0] + rng.normal(scale=0.01, size=300)
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(X, y)], "a double, b double, y double")
    c = li.fit_linear_models(df, ["a", "b"], "y", models={"L": ("lasso", 0.5)}).coefficients.first()["coef"]
    assert abs(c[1]) < 1e-9 and c[0] > 2


def test_folds_disjoint_and_complete(spark):
    df = spark.range(0, 103).select(F.col("id").alias("question_id"), (F.col("id") % 3 == 0).cast("int").alias("label_binary"))
    f = sp.stratified_folds(df, k=5).toPandas()
    assert len(f) == 103 and f["question_id"].is_unique
    assert set(f["fold"]) == set(range(5))
    sizes = f.groupby(["label_binary", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()


def test_split_sizes_follow_reference(spark):
    rows = [("a", i, i % 2) for i in range(46)] + [("b", 100 + i, i % 2) for i in range(37)] + \
           [("c", 200 + i, i % 2) for i in range(20)] + [("d", 300 + i, 0) for i in range(14)]
    df = spark.createDataFrame(rows, "db_id string, question_id int, label_binary int")
    s = sp.split_within_group(df).groupBy("db_id", "split").count().collect()
    got = {(r["db_id"], r["split"]): r["count"] for r in s}
    assert got[("a", "test")] == 10 and got[("b", "test")] == 8 and got[("c", "test")] == 4
    assert got[("d", "skipped")] == 14
    st = {r["db_id"]: r["status"] for r in sp.split_status(sp.split_within_group_stratified(df)).collect()}
    assert st["d"] == "skipped_small" and st["a"] == "ok"


def test_seen_pooled_tiny_groups(spark):
    rows = [("t", i, i % 2) for i in range(4)] + [("u", 10, 1)] + [("v", 20 + i, i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "db_id string, question_id int, label_binary int")
    got = sp.split_seen_pooled(df).groupBy("db_id", "split").count().collect()
    c = {(r["db_id"], r["split"]): r["count"] for r in got}
    assert c[("t", "train")] == 3 and c[("t", "test")] == 1  # round(3.2) = 3
    assert c[("u", "train")] == 1 and ("u", "test") not in c
    assert c[("v", "test")] == 4


def test_window_free_rolling_r2_matches_bruteforce(spark):
    from querylens.operators.metrics import rolling_r2
    rng = np.random.default_rng(3)
    y = rng.uniform(0.01, 2, 60)
    p = y * rng.uniform(0.5, 1.5, 60)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))],
                               "id int, runtime_s double, predicted_runtime_s double")
    got = {r["k"]: r["r2_log"] for r in rolling_r2(df).collect()}
    for k in (2, 10, 60):
        ly, lp = np.log1p(y[:k]), np.log1p(np.clip(p[:k], 0, None))
        ref = 1 - ((ly - lp) ** 2).sum() / ((ly - ly.mean()) ** 2).sum()
        assert got[k] == pytest.approx(ref, rel=1e-9)
    assert got[1] is None


def test_window_row_number_reference(spark):
    df = spark.range(0, 500).select((F.col("id") % 4).alias("g"), F.col("id"))
    a = rank_within(df, ["g"], [F.col("id").desc()])
    b = df.withColumn("_rn2", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("id"))) - 1)
    j = a.join(b, ["g", "id"])
    assert j.where(F.col("_rn") != F.col("_rn2")).count() == 0
