"""Quantiles of hot values: equal values are one row before any exchange."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from querylens.operators import catalog as ca
from querylens.operators import ranking as rk


def hot(spark, n=20_000):
    """Nine of ten rows hold one value, over three groups."""
    return spark.range(n).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 10 != 0, 30.0).otherwise(F.rand(1) * 60).alias("v"))


def test_hot_value_quantiles(spark):
    df = hot(spark).cache()
    qs = [0.0, 0.03, 0.5, 0.75, 0.999, 1.0]
    got = {r.g: (r.n, r.quantiles) for r in rk.exact_quantiles(df, "v", qs, ["g"]).collect()}
    for g, (n, q) in got.items():
        v = [r.v for r in df.where(F.col("g") == g).collect()]
        assert n == len(v) and q == pytest.approx(np.quantile(v, qs))


def test_equal_values_are_counted_before_ranking(spark, monkeypatch):
    seen = []
    holding = rk._holding

    def look(counted, *args):
        seen.append((counted.count(), counted.agg(F.max("_c")).first()[0]))
        return holding(counted, *args)

    monkeypatch.setattr(rk, "_holding", look)
    rk.exact_quantiles(hot(spark), "v", [0.5]).collect()
    rows, hottest = seen[0]
    assert len(seen) == 3 and rows <= 2_001 and hottest >= 18_000      # the copies are a counter
    assert all(n <= 2 for n, _ in seen[1:])                            # both positions lie in the hot value


def test_keys_follow_the_order_of_doubles(spark):
    powers = np.array([2.0 ** e for e in range(-1074, 1024)])
    drawn = np.random.default_rng(3).integers(-2 ** 63, 2 ** 63 - 1, 5_000).view(np.float64)
    v = np.concatenate([powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf), -powers, drawn[~np.isnan(drawn)],
                        [0.0, -0.0, np.inf, -np.inf, np.finfo(float).max]])
    rows = rk._with_key(spark.createDataFrame([(float(x),) for x in v], "_v double")).collect()
    assert len(rows) == len(v)
    for r in rows:
        bits = int(np.abs(np.float64(r._v)).view(np.int64))
        assert r._key == (-bits if r._v < 0 else bits)
    nan = rk._with_key(spark.createDataFrame([(float("nan"),)], "_v double")).first()
    assert nan._key > max(r._key for r in rows)


@pytest.mark.parametrize("large_groups", [1, 2, 10, None])
def test_large_and_small_groups(spark, large_groups):
    rng = np.random.default_rng(5)
    rows = [(g, float(x)) for g, n in (("a", 900), ("b", 300), (None, 40), ("c", 1)) for x in np.round(rng.normal(0, 1e3, n), 1)]
    df = spark.createDataFrame(rows, "_v string, n double")             # clashing names
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    last = lambda n: [F.floor(F.lit(q) * (n - 1)) for q in qs]          # noqa: E731
    got = {r["_v"]: (r["n"], r["values"]) for r in rk.values_at(df, "n", last, ["_v"], large_groups).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, (n, at) in got.items():
        v = sorted(x for h, x in rows if h == g)
        assert n == len(v) and at == [v[int(q * (n - 1))] for q in qs]


def test_building_quantiles_runs_nothing(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("quantiles-build", "")
    plan = rk.exact_quantiles(hot(spark), "v", [0.5], ["g"])
    assert list(tracker.getJobIdsForGroup("quantiles-build")) == []
    assert "rangepartitioning(_v" not in plan._jdf.queryExecution().toString()
    spark.sparkContext._jsc.clearJobGroup()


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "g string, v double")
    assert [(r.g, r.n, r.quantiles) for r in rk.exact_quantiles(df, "v", [0.5], ["g"]).collect()] == [("a", 1, [1.0])]
    assert [(r.n, r.quantiles) for r in rk.exact_quantiles(df.limit(0), "v", [0.5]).collect()] == [(None, [None])]
    assert rk.exact_quantiles(df.limit(0), "v", [0.5], ["g"]).count() == 0
    five = {r.col_name: tuple(r)[1:] for r in ca.five_point(df.select("v", F.lit(None).cast("double").alias("w")), ["v", "w"]).collect()}
    assert five == {"v": (1.0,) * 5, "w": (None,) * 5}


def test_a_key_is_worked_out_once_per_value(spark):
    """Behind an Arrow pass the key is a column; as an expression it is repeated wherever it is used."""
    plan = rk._with_key(spark.createDataFrame([(1.5,)], "_v double")).groupBy(F.shiftright("_key", 42)).count()._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "LOG2" not in plan.upper() and "POW" not in plan.upper()
