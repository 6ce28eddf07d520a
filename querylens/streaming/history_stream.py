"""Query history as a stream (ST1-ST4).

* ST1 ingest: file source -> event-time watermark -> ``dropDuplicatesWithinWatermark(id)``
  -> ``actual_label`` and ISO timestamp.
* ST2 running history per database: one streaming aggregate of counts, means
  and centred moments, so the state is a few numbers per database however long
  the history grows; the counts of H4, the means of H5 and E13's R2 and MAE
  are derived from it on read.
* ST3 tiering: stream-static join with the cutoff table (one row per
  database: bounded, broadcast).
* ST4 incremental training set: ``foreachBatch`` that extends a keyed table by
  the rows whose key no earlier batch holds; a manifest of key ranges and Bloom
  filters says which buckets have to be read for that.

Checkpoints live under the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.history import history_training_rows
from ..operators.labels import threshold_label
from ..session import ensure_checkpoint_dir
from .keyed_table import extend, path_exists


def stream_folder(spark: SparkSession, name: str) -> str:
    """Folder of a named stream under the shared checkpoint folder.  Callers
    that restart a stream pass the same folder again."""
    return os.path.join(ensure_checkpoint_dir(spark), f"stream-{name}-{uuid.uuid4().hex[:8]}")


def read_history_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """File source over history parquet files arriving in ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """ST1: dedupe on id within the watermark, derive label and timestamp."""
    # watermarks need TIMESTAMP while parquet may carry TIMESTAMP_NTZ: the
    # watermark runs on a cast copy, the text stamp is formatted from the original
    s = stream.withColumn("_event_ts", F.col("ts").cast("timestamp"))
    s = s.withWatermark("_event_ts", watermark).dropDuplicatesWithinWatermark(["id"])
    return (s.withColumn("actual_label", threshold_label(F.col("runtime_s"), F.col("had_error")))
             .withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).drop("_event_ts"))


def running_moments(stream: DataFrame) -> DataFrame:
    """ST2 state: one streaming aggregate per database with the counts of H4
    (all, errors, valid for metrics, trainable), the sums behind the means of
    H5, and for E13 error sums and centred second moments of the valid rows.
    The variances are merged as centred moments, so nothing cancels however
    long the history is.  A few numbers per database, whatever its rows."""
    y, p = F.col("runtime_s"), F.col("predicted_runtime_s")
    good = F.col("had_error") == 0
    valid = good & y.isNotNull() & p.isNotNull()
    ly, lp = F.log1p(y), F.log1p(F.greatest(p, F.lit(0.0)))
    of = lambda c: F.when(valid, c)
    return stream.groupBy("database").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("had_error") != 0).alias("errors"),
        F.count_if(valid).alias("n"), F.count_if(good & y.isNotNull()).alias("trainable"),
        F.count("id").alias("queries"), F.avg(y).alias("mean_y"), F.avg(p).alias("mean_p"),
        F.var_pop(of(y)).alias("var"), F.sum(of((y - p) * (y - p))).alias("sse"),
        F.sum(of(F.abs(y - p))).alias("sae"), F.var_pop(of(ly)).alias("lvar"), F.sum(of((ly - lp) * (ly - lp))).alias("lsse"))


def metrics_from_moments(m: DataFrame) -> DataFrame:
    """E13 from the ST2 state: r2, r2_log, mae_ms (null below 2 rows or for a
    constant target), for databases with valid rows."""
    n = F.col("n").cast("double")
    enough = F.col("n") >= 2
    return m.where(F.col("n") > 0).select(
        "database", F.col("n").cast("long").alias("n"),
        F.when(enough & (F.col("var") > 0), 1 - F.col("sse") / (F.col("var") * n)).alias("r2"),
        F.when(enough & (F.col("lvar") > 0), 1 - F.col("lsse") / (F.col("lvar") * n)).alias("r2_log"),
        F.when(enough, F.col("sae") / n * 1000).alias("mae_ms"))


def counts_from_moments(m: DataFrame) -> DataFrame:
    """H4 over the whole history from the ST2 state (one row)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return m.agg(total("total").alias("total"), total("errors").alias("errors"), total("n").alias("valid"), total("trainable").alias("trainable"))


def databases_from_moments(m: DataFrame) -> DataFrame:
    """H5 from the ST2 state: queries and mean actual / predicted ms per database."""
    return m.select("database", "queries", (F.col("mean_y") * 1000).alias("avg_actual_ms"), (F.col("mean_p") * 1000).alias("avg_predicted_ms"))


def run_to_table(df: DataFrame, name: str, output_mode: str = "update", key: list[str] | None = None,
                 folder: str | None = None) -> DataFrame:
    """Drive a streaming query over everything available and return the
    result as a batch DataFrame.  ``folder`` holds the stream's checkpoint and
    its table; run again with the same folder, the stream goes on where it
    stopped.  Every batch has a folder of its own, written over when the batch
    is tried again; of update-mode rows the last batch's count per ``key``."""
    spark = df.sparkSession
    folder = folder or stream_folder(spark, name)
    out = os.path.join(folder, "table")

    def upsert(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(os.path.join(out, f"epoch={epoch:08d}"))

    q = (df.writeStream.outputMode(output_mode).option("checkpointLocation", os.path.join(folder, "checkpoint"))
           .foreachBatch(upsert).start())
    q.processAllAvailable()
    q.stop()
    if not path_exists(spark, out):
        return spark.createDataFrame([], df.schema)
    res = spark.read.parquet(out)
    if key:
        last = res.groupBy(*key).agg(F.max("_epoch").alias("_epoch"))
        res = res.join(last, [*key, "_epoch"])
    return res.select(*df.columns)


def tier_stream(stream: DataFrame, cutoffs: DataFrame, labels, db_col: str = "database",
                col: str = "runtime_s") -> DataFrame:
    """ST3: per-db thresholds when present, else global.  The cutoff table
    has one row per database and level (bounded, broadcast); the global
    thresholds are a handful of numbers embedded as a literal array."""
    arrays = (cutoffs.groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct("level", "threshold_s"))).alias("_th"))
              .select(F.col("db_id").alias("_cdb"), F.transform("_th", lambda s: s["threshold_s"]).alias("_th")))
    glob = arrays.where(F.col("_cdb").isNull()).select("_th").first()
    glob_arr = F.array(*[F.lit(float(x)) for x in (glob["_th"] if glob else [])])
    per = arrays.where(F.col("_cdb").isNotNull())
    j = stream.join(per, stream[db_col] == per["_cdb"], "left")
    th = F.coalesce(F.col("_th"), glob_arr)
    j = j.select(*stream.columns, th.alias("_thr"))
    v = F.col(col).cast("double")
    idx = F.size(F.filter("_thr", lambda t: v > t))
    lab = F.element_at(F.array(*[F.lit(x) for x in labels]), idx + 1)
    return j.select(*stream.columns, lab.alias("tier_label"), idx.alias("tier_index"))


def incremental_training(stream: DataFrame, stats: DataFrame, table_path: str, checkpoint: str | None = None) -> int:
    """ST4: append valid new history rows to the training table at
    ``table_path`` (:mod:`.keyed_table`: Parquet, one folder per batch and
    bucket), skipping keys of earlier batches, of which only the buckets that
    may hold one are read.  A batch that is tried again, whole or after a
    partial write, replaces its own folders, so nothing is doubled; with the
    same ``checkpoint`` folder a restarted stream goes on where it stopped.
    Read errors are raised.  Returns the number of rows in the table."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, epoch: int) -> None:
        rows = history_training_rows(batch, stats).withColumn("_id", F.substring_index("question_id", "_", -1).try_cast("long"))
        extend(table_path, rows, epoch, "question_id", "_id")

    where = checkpoint or os.path.join(stream_folder(spark, "train"), "checkpoint")
    q = stream.writeStream.option("checkpointLocation", where).foreachBatch(merge).start()
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(table_path).count() if _has_rows(spark, table_path) else 0


def _has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a training table holds any data file."""
    if not path_exists(spark, path):
        return False
    target = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "batch=*", "*"))
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return any(not s.getPath().getName().startswith(("_", ".")) for s in found or [])


def stage_history_files(history: DataFrame, path: str, n_files: int = 4) -> None:
    """Write a history table as files of a stream source, by a hash of the id
    in ``n_files`` folders (for tests and the registered queries)."""
    part = F.pmod(F.xxhash64("id"), F.lit(n_files)).cast("int")
    history.withColumn("_part", part).repartition("_part").write.partitionBy("_part").mode("append").parquet(path)
