"""A growing table of keyed rows that a batch extends without reading it (ST4, H7).

Layout: ``<path>/batch=<n>/bucket=<b>/…`` holds the rows of batch ``n`` whose key
hashes to bucket ``b``; ``<path>/_manifest/batch=<n>`` one row per bucket with the
smallest and largest key number and a Bloom filter of the keys.  A new batch
compares its own key ranges with the manifest, tests its keys on the filters
of overlapping buckets, and reads the keys of those buckets only that may hold
one of them.  Batches of ever larger numbers thus read no earlier rows at all.
A batch that is tried again replaces its own folders.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship

BUCKETS = 16
BITS_PER_KEY = 12
PROBES = 6


# ---- Bloom filters ---------------------------------------------------------

def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of each key (a row of ``PROBES``), from two halves of its hash."""
    h = hashes.view(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + np.arange(PROBES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)).astype(np.int64)


def bloom_of(hashes: np.ndarray) -> bytes:
    bits = 8 * max(8, -(-len(hashes) * BITS_PER_KEY // 8))
    field = np.zeros(bits, bool)
    field[_probes(hashes, bits).reshape(-1)] = True
    return np.packbits(field).tobytes()


def may_hold(bloom: bytes, hashes: np.ndarray) -> np.ndarray:
    field = np.unpackbits(np.frombuffer(bloom, np.uint8)).astype(bool)
    return field[_probes(hashes, len(field))].all(1)


# ---- files -----------------------------------------------------------------

def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, files = _hadoop(spark, path)
    return files.exists(target)


def _batches(spark: SparkSession, path: str) -> set[int]:
    """Numbers of the batches that have a folder in ``path``."""
    target, files = _hadoop(spark, path)
    if not files.exists(target):
        return set()
    names = [s.getPath().getName() for s in files.listStatus(target)]
    return {int(n.split("=", 1)[1]) for n in names if n.startswith("batch=")}


def _manifest(path: str) -> str:
    return os.path.join(path, "_manifest")


_MANIFEST = "bucket int, lo long, hi long, bloom binary"


def _with_bucket(rows: DataFrame, key: str, number: str) -> DataFrame:
    return rows.withColumn("_hash", F.xxhash64(key)).withColumn("_number", F.col(number).cast("long")).withColumn(
        "bucket", F.pmod("_hash", F.lit(BUCKETS)).cast("int"))


def places(spark: SparkSession, path: str, rows: DataFrame, before: int) -> list[tuple[int, int]]:
    """``(batch, bucket)`` of earlier batches that may hold a key of ``rows`` (with
    ``_hash``, ``_number`` and ``bucket``); at most one per batch and bucket."""
    known = sorted(b for b in _batches(spark, _manifest(path)) if b < before)
    if not known:
        return []
    entries = spark.read.schema(_MANIFEST + ", batch int").option("basePath", _manifest(path)).parquet(
        *[os.path.join(_manifest(path), f"batch={b}") for b in known])
    own = rows.groupBy("bucket").agg(F.min("_number").alias("_lo"), F.max("_number").alias("_hi"), F.count_if(F.col("_number").isNull()).alias("_odd"))
    # keys without a number may be anywhere
    near = entries.join(own, "bucket").where((F.col("_odd") > 0) | F.col("lo").isNull() | ((F.col("lo") <= F.col("_hi")) & (F.col("hi") >= F.col("_lo"))))
    some = near.select("batch", "bucket").collect()
    if not some:
        return []
    ship(spark)

    def probe(keys, filters):
        hashes = keys.column("_hash").to_numpy()
        hit = [bool(may_hold(b, hashes).any()) for b in filters.column("bloom").to_pylist()]
        return filters.select(["batch", "bucket"]).filter(pa.array(hit, pa.bool_()))

    pairs = near.select("batch", "bucket", "bloom").groupBy("bucket")
    return sorted((r["batch"], r["bucket"]) for r in rows.select("bucket", "_hash").groupBy("bucket").cogroup(pairs).applyInArrow(
        probe, "batch int, bucket int").collect())


def earlier_keys(spark: SparkSession, path: str, rows: DataFrame, before: int, key: str) -> DataFrame | None:
    """Keys of the earlier batches' buckets that may hold one of ``rows``, and all
    keys of batches that have no manifest; None if there are none."""
    loose = sorted(b for b in _batches(spark, path) - _batches(spark, _manifest(path)) if b < before)
    folders = [os.path.join(path, f"batch={b}", f"bucket={k}") for b, k in places(spark, path, rows, before)]
    parts = [spark.read.parquet(*folders).select(key)] if folders else []
    parts += [spark.read.parquet(os.path.join(path, f"batch={b}")).select(key) for b in loose]
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def extend(path: str, rows: DataFrame, batch: int, key: str, number: str) -> None:
    """Add the rows of batch ``batch`` whose key no earlier batch holds, one per
    key.  ``number`` is a numeric column that tends to grow with the batches
    (null: unknown)."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    mine = _with_bucket(rows.dropDuplicates([key]), key, number).checkpoint()      # read by the manifest's join and by the writer
    held = earlier_keys(spark, path, mine, batch, key)
    new = mine if held is None else mine.join(held, key, "left_anti")
    folder = os.path.join(path, f"batch={batch}")
    new.drop("_hash", "_number", *([number] if number.startswith("_") else [])).repartition("bucket").write.partitionBy("bucket").mode(
        "overwrite").parquet(folder)

    def entry(key, table):
        numbers = table.column("_number")
        known = len(numbers) - numbers.null_count == len(numbers)
        values = numbers.to_numpy(zero_copy_only=False) if known else None
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()),
                         "lo": pa.array([int(values.min()) if known else None], pa.int64()),
                         "hi": pa.array([int(values.max()) if known else None], pa.int64()),
                         "bloom": pa.array([bloom_of(table.column("_hash").to_numpy())], pa.binary())})

    ship(spark)
    # a bucket of one batch is one task's group
    new.select("bucket", "_hash", "_number").groupBy("bucket").applyInArrow(entry, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(
        os.path.join(_manifest(path), f"batch={batch}"))
