"""Ranks and selections by counting against a plain sort."""

import pytest
from pyspark.sql import functions as F

from querylens.operators import splits as sp
from querylens.operators.selection import first_rows, hash_rank


@pytest.fixture(scope="module")
def rows(spark):
    # a stratum with a third of the rows, a null one, repeated keys
    df = spark.range(900).select((F.col("id") % 850).alias("key"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None))
                                 .otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("s"), F.col("id").alias("value"))
    return df.withColumn("h", F.md5(F.col("key").cast("string"))).cache()


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_rank_and_selection_equal_a_sort(spark, rows, monkeypatch, digits):
    monkeypatch.setattr("querylens.operators.selection.DIGITS", digits)
    groups: dict = {}
    for r in rows.collect():
        groups.setdefault(r.s, []).append(r.h)
    ranked = hash_rank(rows, ["s"], "h").collect()
    assert len(ranked) == 900
    for s, hashes in groups.items():
        own = sorted((r._rn, r.h) for r in ranked if r.s == s)
        assert [n for n, _ in own] == list(range(len(hashes))) and [h for _, h in own] == sorted(hashes)
    want = {"hot": 100, None: 5, "s1": 0, "s2": 10_000, "s4": 1}
    quotas = spark.createDataFrame(list(want.items()), "s string, _quota long")
    marked = first_rows(rows, ["s"], "h", quotas).collect()
    assert len(marked) == 900
    for s, hashes in groups.items():
        q = min(want.get(s, 0), len(hashes))
        assert sorted(r.h for r in marked if r.s == s and r._first) == sorted(hashes)[:q]
    whole = first_rows(rows, [], "h", spark.createDataFrame([(37,)], "_quota long"))
    assert sorted(r.h for r in whole.collect() if r._first) == sorted(r.h for r in rows.collect())[:37]


def test_nothing_runs_when_a_split_is_built(spark):
    seen = []
    df = spark.range(100).select(F.col("id").alias("question_id"), F.lit("d").alias("db_id"), (F.col("id") % 2).cast("int").alias("label_binary"))
    checkpoint = type(df).checkpoint
    try:
        type(df).checkpoint = lambda self, *a, **k: seen.append(1) or checkpoint(self, *a, **k)
        splits = [sp.split_random_stratified(df), sp.split_within_group(df), sp.split_within_group_stratified(df), sp.split_seen_pooled(df),
                  sp.stratified_folds(df)]
    finally:
        type(df).checkpoint = checkpoint
    assert not seen
    assert [s.where("split = 'test'").count() for s in splits[:4]] == [20, 20, 20, 20]
    assert sorted(r["count"] for r in splits[4].groupBy("fold", "label_binary").count().collect()) == [10] * 10
