"""Streaming equals batch; the workload runner records runs and errors."""

import os
import tempfile

from pyspark.sql import functions as F

from querylens.operators import metrics as me
from querylens.plans import workload as wl
from querylens.sources import fixtures as fx
from querylens.streaming import history_stream as hs

from .conftest import SMALL


def test_stream_moments_equal_batch(spark):
    hist = fx.history(spark, SMALL)
    path = os.path.join(tempfile.mkdtemp(prefix="ql-test-"), "src")
    hs.stage_history_files(hist, path, n_files=3)
    stream = hs.read_history_stream(spark, path, hist.schema)
    state = hs.run_to_table(hs.running_moments(stream), "t_moments", key=["database"])
    s = {r["database"]: r for r in hs.metrics_from_moments(state).collect()}
    valid = hist.where((F.col("had_error") == 0) & F.col("runtime_s").isNotNull() & F.col("predicted_runtime_s").isNotNull())
    b = {r["database"]: r for r in me.history_metrics(valid, ["database"]).collect()}
    assert s.keys() == b.keys()
    for db in b:
        assert s[db]["n"] == b[db]["n"]
        for c in ("r2", "r2_log", "mae_ms"):
            if b[db][c] is None:
                assert s[db][c] is None
            else:
                assert abs(s[db][c] - b[db][c]) < 1e-9 * max(1.0, abs(b[db][c]))


def test_workload_runner(spark):
    wl.register_tables(spark, SMALL)
    runs = wl.run_workload(spark, [(1, "tpch", "SELECT count(*) FROM orders"),
                                   (2, "tpch", "SELECT * FROM no_such_table")], runs=2).collect()
    ok = [r for r in runs if r["question_id"] == 1]
    bad = [r for r in runs if r["question_id"] == 2]
    assert len(ok) == 2 and all(r["error"] is None and r["row_count"] == 1 for r in ok)
    assert len(bad) == 1 and bad[0]["error"]  # the first failure ends the question


def _folder():
    return tempfile.mkdtemp(prefix="ql-test-")


def test_restarted_stream_goes_on(spark):
    hist = fx.history(spark, SMALL)
    src, folder = os.path.join(_folder(), "src"), _folder()
    early = hist.where("id % 3 = 0")
    early.write.parquet(src)
    run = lambda: hs.run_to_table(hs.running_moments(hs.read_history_stream(spark, src, hist.schema)), "restart",
                                  key=["database"], folder=folder)
    first = {r.database: r.n for r in run().collect()}
    hist.where("id % 3 <> 0").write.mode("append").parquet(src)
    both = {r.database: r.n for r in run().collect()}
    valid = "had_error = 0 AND runtime_s IS NOT NULL AND predicted_runtime_s IS NOT NULL"
    count = lambda df: {r.database: r["count"] for r in df.where(valid).groupBy("database").count().collect()}
    assert first == count(early) and both == count(hist)


def test_ingest_over_several_batches(spark):
    hist = fx.history(spark, SMALL)
    src, folder = os.path.join(_folder(), "src"), _folder()
    seen = 0
    for part in (hist.orderBy("ts", "id").limit(200), hist.orderBy("ts", "id").limit(400)):
        part.write.mode("append").parquet(src)
        out = hs.run_to_table(hs.ingest(hs.read_history_stream(spark, src, hist.schema, 1000)), "again", "append", folder=folder)
        assert out.count() >= seen
        seen = out.count()
    assert out.select("id").distinct().count() == out.count()      # the second file repeats the first one's rows


def test_training_table_takes_a_batch_once(spark):
    from querylens.operators import catalog as ca
    hist = fx.history(spark, SMALL)
    stats = ca.schema_stats(fx.catalog_tables(spark, SMALL))
    src, table, checkpoint = os.path.join(_folder(), "src"), os.path.join(_folder(), "table"), _folder()
    hist.where("id % 2 = 0").write.parquet(src)
    stream = lambda: hs.read_history_stream(spark, src, hist.schema, 1000)
    n = hs.incremental_training(stream(), stats, table, checkpoint)
    assert n == hs.incremental_training(stream(), stats, table, checkpoint)          # nothing new
    assert n == hs.incremental_training(stream(), stats, table, _folder())           # batch 0 once more
    hist.where("id % 2 = 1").write.mode("append").parquet(src)
    total = hs.incremental_training(stream(), stats, table, checkpoint)
    keys = spark.read.parquet(table).select("question_id")
    assert total == keys.count() == keys.distinct().count() > n


def test_training_table_raises_read_errors(spark):
    import pytest
    from querylens.operators import catalog as ca
    hist = fx.history(spark, SMALL)
    src, table = os.path.join(_folder(), "src"), os.path.join(_folder(), "table")
    hist.write.parquet(src)
    os.makedirs(os.path.join(table, "batch=-1"))
    with open(os.path.join(table, "batch=-1", "part-0.parquet"), "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        hs.incremental_training(hs.read_history_stream(spark, src, hist.schema, 1000), ca.schema_stats(fx.catalog_tables(spark, SMALL)), table)
