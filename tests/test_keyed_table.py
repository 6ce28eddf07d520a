"""The keyed training table: what a batch reads, and that nothing doubles."""

import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from querylens.streaming import keyed_table as kt


def folder():
    return os.path.join(tempfile.mkdtemp(prefix="ql-test-"), "table")


def rows(spark, ids):
    df = spark.createDataFrame([(f"history_{i}", float(i), i) for i in ids], "question_id string, runtime_s double, _id long")
    return df.repartition(2)


def keys(spark, path):
    return [r.question_id for r in spark.read.parquet(path).collect()]


def test_filters_hold_their_keys():
    h = np.random.default_rng(0).integers(-2**62, 2**62, 20_000)
    bloom = kt.bloom_of(h[:10_000])
    assert kt.may_hold(bloom, h[:10_000]).all() and kt.may_hold(bloom, h[10_000:]).mean() < 0.02


def test_growing_keys_read_nothing(spark, monkeypatch):
    """Fifty batches of new numbers: no bucket of an earlier batch is read."""
    monkeypatch.setattr(kt, "BUCKETS", 2)
    path, read = folder(), []
    found = kt.places
    monkeypatch.setattr(kt, "places", lambda *a: read.append(found(*a)) or read[-1])
    for n in range(50):
        kt.extend(path, rows(spark, range(10 * n, 10 * n + 10)), n, "question_id", "_id")
    assert read == [[]] * 50
    got = keys(spark, path)
    assert len(got) == 500 == len(set(got))


def test_only_buckets_that_may_hold_a_key_are_read(spark, monkeypatch):
    path, read = folder(), []
    found = kt.places
    monkeypatch.setattr(kt, "places", lambda *a: read.append(found(*a)) or read[-1])
    for n in range(4):      # interleaved numbers: all ranges overlap
        kt.extend(path, rows(spark, range(n, 400, 4)), n, "question_id", "_id")
    assert sum(map(len, read)) < 0.2 * 6 * kt.BUCKETS       # the filters rule most of them out
    read.clear()
    again = [5, 5, 9, 13, 1000, 1001]
    kt.extend(path, rows(spark, again), 4, "question_id", "_id")
    assert {b for b, _ in read[0]} >= {1} and len(read[0]) <= 6
    got = keys(spark, path)
    assert sorted(got) == sorted(f"history_{i}" for i in [*range(400), 1000, 1001])
    # the same batch once more replaces itself
    kt.extend(path, rows(spark, again), 4, "question_id", "_id")
    assert sorted(keys(spark, path)) == sorted(got)


def test_batches_without_manifest_and_keys_without_number(spark):
    path = folder()
    rows(spark, range(5)).drop("_id").write.parquet(os.path.join(path, "batch=0"))
    odd = rows(spark, [3, 7]).unionByName(spark.createDataFrame([("other", 1.0, None)], "question_id string, runtime_s double, _id long"))
    kt.extend(path, odd, 1, "question_id", "_id")
    kt.extend(path, odd, 2, "question_id", "_id")
    kt.extend(path, odd.limit(0), 3, "question_id", "_id")
    got = [r.question_id for b in (0, 1) for r in spark.read.parquet(os.path.join(path, f"batch={b}")).collect()]
    assert sorted(got) == sorted([*(f"history_{i}" for i in range(5)), "history_7", "other"])
    assert not [d for d in os.listdir(os.path.join(path, "batch=2")) if d.startswith("bucket=")]
