"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per session."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    archive = os.path.join(tempfile.mkdtemp(prefix="querylens-"), "querylens_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


#: Bytes of an Arrow batch sent to a Python worker, where the session keeps
#: Spark's default of 64 MB; a single longer row is a batch of its own.
BATCH_BYTES = 8 << 20


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the workers and small batches, so
    that a worker holds a few megabytes of texts at a time."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864", "67108864b", "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def grouped(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of one key together and in order within a partition."""
    n = shuffle_partitions(df.sparkSession)
    return df.repartition(n, *keys).sortWithinPartitions(*keys)


def sorted_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.RecordBatch]:
    """The runs of rows with equal ``keys`` (longs or ints, not null) of a
    sorted partition, across batch borders."""
    pending: list[pa.RecordBatch] = []
    last = None

    def flush():
        return pending[0] if len(pending) == 1 else pa.concat_batches(pending)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if pending and key != last:
                yield flush()
                pending = []
            pending.append(batch.slice(a, b - a))
            last = key
    if pending:
        yield flush()


def in_blocks(members: DataFrame, size: str, block: int, node: str) -> DataFrame:
    """Split the members of each bucket (``size`` rows) into blocks of about
    ``block`` and give every pair of blocks of a bucket its own rows: columns
    ``bi <= bj`` name the pair and ``own`` the member's block.  Two members of a
    bucket meet in exactly one pair of blocks, and no task sees more than two
    blocks."""
    n = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.col(node)), n.cast("long")).cast("int")
    return (members.withColumn("own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
            .withColumn("bi", F.least("own", "_other")).withColumn("bj", F.greatest("own", "_other")).drop("_other"))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest linked index of each of ``n`` items under links a-b."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(a.tolist(), b.tolist()):
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j)] = min(i, j)
    return np.array([find(i) for i in range(n)], np.int64)


def materialise(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet into the cluster's shared folder and read
    it back: the lineage ends there, every later branch sees the same rows,
    and a lost executor costs no recomputation.  ``parts`` bounds the number
    of files of a table known to be small.  The files go when the driver
    process ends."""
    spark = df.sparkSession
    if parts:
        df = df.coalesce(parts)
    path = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def not_broadcast(df: DataFrame) -> DataFrame:
    """For a join: neither side is ever sent whole through the driver.  Spark
    sizes an array as one element, an exploded table as what it came from and
    a compressed file as its rows, so it would broadcast tables that are many
    times larger than its limit."""
    return df.hint("merge")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def as_text(column: str | Column) -> Column:
    """A text column with null as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (pairs of longs), the
    component being named by its smallest node.

    Alternating large-star and small-star steps (Kiveris et al. 2014): every
    step is one aggregate and one join on distributed rows, the number of
    edges never grows, and O(log n) steps reach one star per component.
    Neither the links nor the components pass through the driver, which only
    sees a count and a checksum per step.  An edge list without rows gives no
    rows.
    """
    def tidy(hi_lo: DataFrame) -> DataFrame:
        return (hi_lo.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                .where("hi > lo").distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    now = materialise(tidy(edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b"))), "cc")
    before, current = None, state(now)
    while current[0] and before != current:
        before = current
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # every u has its least; to the left of an outer join, ``both`` is never broadcast: its compressed file looks small
        large = tidy(both.join(least, "u", "left").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(
            F.explode(F.array(F.struct(F.col("hi").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("lo").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = materialise(tidy(small.select("e.a", "e.b")), "cc")
        current = state(now)
    return (now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
            .union(now.select("lo", "lo").distinct()))
