"""Joint fits against plain one-fit versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from querylens.operators import fits, newton, trees
from querylens.operators.fits import LogisticSpec, fit_all, fit_table, predict_by_key, score_all
from querylens.operators.trees import TreeSpec

FEATURES = ["a", "b", "c", "d"]


def sample(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n), rng.integers(0, 2, n), rng.normal(size=n).round(2), np.ones(n)])
    y = (x[:, 0] + 3 * x[:, 1] + x[:, 2] + rng.normal(size=n) > 5).astype(int)
    return x, y, rng.integers(0, 5, n), 2 * x[:, 0] - x[:, 2] ** 2 + rng.normal(size=n) * 0.1


@pytest.fixture(scope="module")
def table(spark):
    x, y, cell, z = sample()
    rows = [(i, *map(float, r), int(t), int(c), float(v)) for i, (r, t, c, v) in enumerate(zip(x, y, cell, z))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int, cell int, z double").repartition(7).cache()


FITS = {"all": {0, 1, 2, 3, 4}, "some": {0, 2}, "one": {3}}


# ---- logistic -------------------------------------------------------------------

def plain_logistic(x, y, penalty):
    """Newton steps on the whole matrix."""
    sd = x.std(0)
    z = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / np.where(sd > 0, sd, 1)])
    ridge = penalty * np.diag([0, *np.ones(x.shape[1])])
    theta = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ theta))
        theta = theta - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ theta)
    return theta


def test_logistic_fits_equal_plain_newton(table, monkeypatch):
    x, y, cell, _ = sample()
    rows = fit_table(table, FEATURES, "y", F.col("cell"), ["id"])
    passes = []
    step = newton._pass
    monkeypatch.setattr(newton, "_pass", lambda *a: passes.append(1) or step(*a))
    jobs = [(f, LogisticSpec(penalty)) for f in FITS for penalty in (1.0, 0.01)]
    models = fit_all(rows, FITS, jobs)
    assert len(passes) <= 15            # for all fits together
    for (f, spec), m in zip(jobs, models):
        mine = np.isin(cell, list(FITS[f]))
        want = plain_logistic(x[mine], y[mine], spec.penalty)
        assert np.allclose([m.intercept, *m.coef], want, atol=1e-6) and m.coef[3] == 0
        assert np.allclose(m.predict(x[mine]), 1 / (1 + np.exp(-(np.column_stack([np.ones(mine.sum()), (x[mine] - m.mean) / m.scale]) @ want))), atol=1e-6)


def test_steps_that_raise_the_loss_are_halved(spark):
    """Far outliers and nearly no penalty: a full step from the start overshoots."""
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=30), [80.0, -90.0, 120.0]])
    y = (v + rng.normal(size=33) * 0.3 > 0).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, y)], "v double, y int")
    m = fit_all(fit_table(df, ["v"], "y", F.lit(0)), {"all": {0}}, [("all", LogisticSpec(1e-3))])[0]
    z = (v - v.mean()) / v.std()
    p = 1 / (1 + np.exp(-(m.intercept + m.coef[0] * z)))
    assert abs((p - y).sum()) < 1e-6 and abs(((p - y) * z).sum() + 1e-3 * m.coef[0]) < 1e-6      # the gradient is zero


def test_one_class_is_an_error(table):
    rows = fit_table(table.withColumn("y", F.lit(1)), FEATURES, "y", F.col("cell"))
    with pytest.raises(ValueError, match="two classes"):
        fit_all(rows, FITS, [("one", LogisticSpec())])
    with pytest.raises(ValueError, match="two classes"):
        fit_all(rows, {"none": {99}}, [("none", LogisticSpec())])
    with pytest.raises(ValueError, match="no training rows"):
        fit_all(rows, {"none": {99}}, [("none", TreeSpec(forest=True, trees=1))])


# ---- trees ----------------------------------------------------------------------

def plain_boost(x, y, spec):
    """Boosting by trying every split of every node on the rows themselves."""
    log = spec.log
    start = np.log(y.mean() / (1 - y.mean())) if log else y.mean()
    score, out = np.full(len(y), start), []

    def tree(rows, depth, g, b, c):
        leaf = spec.rate * g[rows].sum() / (c[rows].sum() + spec.l2)
        best = None
        base = g[rows].sum() ** 2 / (b[rows].sum() + spec.l2)
        if depth < spec.depth:
            for f in range(x.shape[1]):
                v = np.unique(x[rows, f])
                for cut in (v[1:] + v[:-1]) / 2:
                    left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if min(b[left].sum(), b[right].sum()) < (spec.min_curvature if spec.second_order else 0):
                        continue
                    gain = sum(g[s].sum() ** 2 / (b[s].sum() + spec.l2) for s in (left, right)) - base
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-7):
                        best = gain, f, cut, left, right
        if best is None:
            return leaf
        return best[1], best[2], tree(best[3], depth + 1, g, b, c), tree(best[4], depth + 1, g, b, c)

    def value(node, r):
        while isinstance(node, tuple):
            node = node[2] if r[node[0]] <= node[1] else node[3]
        return node

    for _ in range(spec.trees):
        p = 1 / (1 + np.exp(-score)) if log else score
        g, h = y - p, p * (1 - p) if log else np.ones(len(y))
        t = tree(np.arange(len(y)), 0, g, h if spec.second_order else np.ones(len(y)), h)
        score = score + np.array([value(t, r) for r in x])
        out.append(t)
    return 1 / (1 + np.exp(-score)) if log else score


SPECS = {"boosted": TreeSpec(forest=False, trees=6, depth=3, rate=0.1), "second": TreeSpec(forest=False, trees=5, depth=4, rate=0.3, second_order=True, l2=1.0, min_curvature=1.0),
         "squared": TreeSpec(forest=False, trees=6, depth=3, rate=0.1, log=False)}


@pytest.mark.parametrize("name", list(SPECS))
def test_boosting_equals_brute_force(spark, name):
    x, y, _, z = sample(150, 5)
    target = z if name == "squared" else y.astype(float)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, target)], "a double, b double, c double, d double, y double")
    m = fit_all(fit_table(df, FEATURES, "y", F.lit(0)), {"all": {0}}, [("all", SPECS[name])])[0]
    assert np.allclose(m.predict(x), plain_boost(x, target, SPECS[name]), atol=2e-4)


JOBS = [("all", SPECS["boosted"]), ("some", SPECS["second"]), ("all", TreeSpec(forest=True, trees=4, some=True, seed=7)),
        ("one", TreeSpec(forest=True, trees=3, depth=4, seed=8))]


def equal(a, b) -> bool:
    """Equal trees: the same splits and values on the way to every leaf."""
    x = np.array([[i, j, c, 1.0] for i in range(9) for j in range(2) for c in np.linspace(-3, 3, 61)])
    return len(a.feature) == len(b.feature) and np.array_equal(np.sort(a.gain), np.sort(b.gain)) and np.array_equal(a.predict(x), b.predict(x))


def test_same_trees_for_any_partitioning_and_size(table, monkeypatch):
    """Whole fits in one task, distributed levels, and levels down to small
    nodes give the same trees."""
    rows = fit_table(table, FEATURES, "y", F.col("cell"))
    local = fit_all(rows, FITS, JOBS)
    other = fit_table(table.repartition(3, "c").sortWithinPartitions("a"), FEATURES, "y", F.col("cell"))
    assert all(equal(a, b) for a, b in zip(local, fit_all(other, FITS, JOBS)))
    for limit in (0, 40):
        monkeypatch.setattr(trees, "LOCAL_ROWS", limit)
        assert all(equal(a, b) for a, b in zip(local, fit_all(rows, FITS, JOBS)))


def test_repeated_rows_are_weights(table):
    jobs = [("all", SPECS["boosted"]), ("all", SPECS["second"])]
    twice = table.unionByName(table).unionByName(table)
    once, thrice = (fit_all(fit_table(t, FEATURES, "y", F.col("cell")), FITS, jobs) for t in (table, twice))
    x = sample()[0]
    assert np.allclose(once[0].predict(x), thrice[0].predict(x), atol=1e-5)      # the variance of the gradient has no penalty


def test_poisson_weights():
    keys = trees.mix(np.arange(40_000, dtype=np.uint64))
    for w in (1, 2, 3, 37, 1000):
        drawn = trees.poisson(np.full(len(keys), w, np.int64), keys, np.uint64(9))
        assert abs(drawn.mean() - w) < 5 * np.sqrt(w / len(keys)) and abs(drawn.var() / w - 1) < 0.06
    a, b = (trees.poisson(np.ones(len(keys), np.int64), keys, trees.tree_key(TreeSpec(True, 2), t)) for t in (0, 1))
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.03


def test_forest_learns(spark):
    x, y, _, _ = sample(1500, 9)
    df = spark.createDataFrame([(*map(float, r), int(t), int(i >= 1000)) for i, (r, t) in enumerate(zip(x, y))],
                               "a double, b double, c double, d double, y int, cell int")
    m = fit_all(fit_table(df, FEATURES, "y", F.col("cell")), {"train": {0}}, [("train", TreeSpec(forest=True, trees=40, some=True))])[0]
    right = (m.predict(x) > 0.5) == y
    assert right[:1000].mean() > 0.97 and right[1000:].mean() > 0.8
    share = m.importance()
    assert share.sum() == pytest.approx(1) and share[0] > share[1] > share[3] == 0


def test_many_distinct_values_are_cut_at_quantiles(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("double").alias("v"), F.lit(3.0).alias("k"))
    edges = trees.edges_of(df, ["v", "k"], bins=10)
    assert edges[0].tolist() == [499.0 + 500 * i for i in range(9)] and not len(edges[1])


def test_compiled_ensembles(table, spark):
    rows = fit_table(table, FEATURES, "y", F.col("cell"), ["id"])
    models = fit_all(rows, FITS, JOBS)
    x = sample()[0]
    for m in models:
        again = trees.Ensemble.from_bytes(m.to_bytes())
        assert np.array_equal(again.predict(x), m.predict(x))
    # a pass per model gives the same scores as one for all
    wanted = [(i, m, {c: "x" for c in range(5)}) for i, m in enumerate(models)]
    one, many = ({(r.id, r.job): r.raw for r in score_all(rows, wanted, limit).collect()} for limit in (1 << 30, 1))
    assert one == many and len(one) == 4 * 400
    keyed = table.withColumn("key", F.concat(F.lit("k"), F.col("cell").cast("string")))
    got = predict_by_key(keyed, FEATURES, ["id", "key"], "key", {"k1": models[0], "k3": models[2], "k9": models[1]}).collect()
    assert {(r.id, r.raw) for r in got} == {(r.id, one[r.id, 0 if r.key == "k1" else 2]) for r in got}
    assert {r.key for r in got} == {"k1", "k3"}


SQUARED = [("all", TreeSpec(forest=False, trees=5, depth=3, rate=0.1, log=False)), ("all", TreeSpec(forest=True, trees=6, log=False, seed=3)),
           ("all", TreeSpec(forest=True, trees=3, depth=3, some=True, log=False, seed=4))]


def test_many_values_on_few_bins_need_no_levels(spark, monkeypatch):
    """Squared loss and forests over rows of many values: the trees of the single rows, without a pass per level."""
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.integers(0, 5, 1200), rng.integers(0, 4, 1200), np.ones(1200), rng.integers(0, 2, 1200)])
    z = x[:, 0] - 2 * x[:, 1] * x[:, 3] + rng.normal(size=1200)
    rows = [(*map(float, r), float(v)) for r, v in zip(x, z)]
    df = spark.createDataFrame(rows + rows[:100], "a double, b double, c double, d double, z double").repartition(5)
    table = fit_table(df, FEATURES, "z", F.lit(0))
    single = fit_all(table, {"all": {0}}, SQUARED)
    monkeypatch.setattr(trees, "LOCAL_ROWS", 100)          # 1200 rows, at most 40 of bins
    kept = trees._fit_levels

    def none(rows, jobs, *args):
        assert not jobs
        return kept(rows, jobs, *args)

    monkeypatch.setattr(trees, "_fit_levels", none)
    assert all(equal(a, b) for a, b in zip(single, fit_all(table, {"all": {0}}, SQUARED)))


def test_distinct_rows():
    rng = np.random.default_rng(2)
    for x in (rng.integers(0, 3, (500, 4)).astype(float), rng.integers(0, 3, (500, 4)).astype(np.uint8), np.zeros((3, 0)), np.zeros((0, 2)),
              np.array([[np.nan, 1.0], [np.nan, 1.0], [-0.0, 2.0]])):
        first, at = trees.distinct_rows(x)
        assert np.array_equal(x[first][at], x, equal_nan=x.dtype == float)
        assert len(first) == len({r.tobytes() for r in x})


def test_equal_rows_reach_a_model_once(table, monkeypatch):
    rows = fit_table(table.unionByName(table), FEATURES, "y", F.col("cell"), ["id"])
    seen = []
    monkeypatch.setattr(newton.Logistic, "predict", lambda self, x: seen.append(len(x)) or np.zeros(len(x)))
    import pyarrow as pa
    batch = pa.RecordBatch.from_pandas(rows.df.toPandas(), preserve_index=False)
    model = newton.Logistic(0.0, np.zeros(4), np.zeros(4), np.ones(4))
    (job, mine, names, part, raw, at), = fits._scores(batch, rows.columns, [(0, model, {c: "x" for c in range(5)})])
    assert len(mine) == len(at) == len(part) == 800 and seen == [len(np.unique(sample()[0], axis=0))] == [len(raw)]


def test_counts_are_the_rows_of_all_scores(table):
    rows = fit_table(table.withColumn("y", F.when(F.col("id") % 50 != 0, F.col("y"))), FEATURES, "y", F.col("cell"), ["id"])
    models = fit_all(fit_table(table, FEATURES, "y", F.col("cell")), FITS, JOBS)
    wanted = [(i, m, {c: "test" if c == i else "train" for c in range(4)}) for i, m in enumerate(models)]
    want = {tuple(r) for r in score_all(rows, wanted).groupBy("_y", "job", "part", "raw").count().collect()}
    got = [tuple(r) for r in fits.score_counts(rows, wanted).collect()]
    assert set(got) == want and len(got) == len(want) and sum(r[-1] for r in got) == 4 * sum(sample()[2] < 4)


def test_logistic_passes_read_weighted_rows(table, monkeypatch):
    seen = []
    step = newton._pass
    monkeypatch.setattr(newton, "_pass", lambda df, *a: seen.append((df.count(), df.agg(F.sum("_w")).first()[0])) or step(df, *a))
    many = fit_table(table.unionByName(table).unionByName(table), FEATURES, "y", F.col("cell"))
    fit_all(many, FITS, [("all", LogisticSpec())])
    assert set(seen) == {(table.select("cell", "y", *FEATURES).distinct().count(), 1200)}


def test_equal_rows_are_written_once(table, monkeypatch):
    many = table.unionByName(table).unionByName(table)
    rows = fits.count_table(many, FEATURES, "y", F.col("cell"))
    assert rows.df.count() <= table.count() and rows.df.agg(F.sum("_w")).first()[0] == many.count()
    plain = fit_table(many, FEATURES, "y", F.col("cell"))
    one, other = fit_all(rows, FITS, JOBS), fit_all(plain, FITS, JOBS)
    for a, b in zip(one, other):
        if isinstance(a, newton.Logistic):
            assert np.allclose(a.coef, b.coef, rtol=1e-9, atol=1e-12) and np.allclose(a.scale, b.scale, rtol=1e-12)
        else:
            assert equal(a, b)
    wanted = [(i, m, {c: "part" for c in range(5)}) for i, m in enumerate(one)]
    both = [{tuple(r) for r in fits.score_counts(x, wanted).collect()} for x in (rows, plain)]
    assert both[0] == both[1]
    with pytest.raises(ValueError):
        score_all(rows, wanted)


def test_evaluations_fit_on_rows_brought_together(spark, table, monkeypatch):
    from querylens.operators import models
    seen = []
    plain = fits.fit_all
    monkeypatch.setattr(models, "fit_all", lambda rows, *a: seen.append(rows.df) or plain(rows, *a))
    df = table.select(F.col("id").alias("question_id"), F.col("y").alias("label_binary"), F.round("a").alias("a"))
    scores, rows_of = models.cross_validation(df.withColumn("a", F.col("a") % 3), ["a"], ["Logistic Regression", "Gradient Boosting"], k=3)
    assert all(d.groupBy("_cell", "_y", "_f0").count().where("count > 1").isEmpty() and d.agg(F.sum("_w")).first()[0] == df.count() for d in seen)
    one = rows_of(["Gradient Boosting"])
    assert {r["model"] for r in one.select("model").distinct().collect()} == {"Gradient Boosting"}
    assert one.count() == df.count() and rows_of([]).isEmpty()
