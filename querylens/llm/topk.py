"""Exact top-k inner products by an impact-ordered index, score at a time.

Vectors of integers are indexed in blocks.  A block's index holds its
postings (vector, dimension, component) in order of descending impact: the
component's size, quantised to steps of ``STEP``.  Postings of one impact are a
segment.  A block of queries meets the segments in that order, in rounds; a
round adds its postings to the accumulators of all queries still open.

A vector's upper bound is its accumulator, the quantisation error of the
dimensions met, and for every other dimension the query's component times the
impact at which the round ended.  After a round the vectors with the best
bounds are scored exactly, which gives a lower bound for the k-th best score.
A query's search of the block stops only when at most ``RESCORE`` vectors have
an upper bound that reaches it (or all segments are done); all of those are
scored exactly, so the result is exact.

The query set meets the blocks in blocks of its own.  A unit of work holds a
few blocks of the index and streams all blocks of queries past them, so a block
of the index is sent once, a block of queries once per unit, and nothing by way
of the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import grouped, map_arrow, materialise, shuffle_partitions, sorted_groups
from .vectors import finite

STEP = 4
ROWS = 4096            # vectors per block of the index
QUERIES = 256          # queries per block
SPAN = 8               # blocks of the index per unit of work, at most
PROBES = 32            # vectors scored after a round for the lower bound
RESCORE = 256
ROUNDS = (0.8, 0.95, 1.0)         # shares of the postings after each round


def _padded(lists: pa.Array, dim: int) -> np.ndarray:
    """Integer vectors as a matrix; missing components are 0."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py():lists.offsets[-1].as_py()]
    out = np.zeros((len(n), dim), np.int64)
    out[np.arange(dim) < n[:, None]] = flat
    return out


def impact(values: np.ndarray) -> np.ndarray:
    """Largest size of a component in the same step."""
    low = values // STEP * STEP
    return np.maximum(np.abs(low), np.abs(low + STEP - 1))


def impact_order(values: np.ndarray) -> np.ndarray:
    return np.argsort(-impact(values).ravel(), kind="stable").astype(np.int32)


def _packed(values: np.ndarray) -> bytes:
    """Integers in the narrowest of two, four or eight bytes that holds all."""
    kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= values.min() and values.max() <= np.iinfo(t).max)
    return values.astype(kind).tobytes()


def _unpacked(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"i{len(data) // (n * dim)}").astype(np.int64).reshape(n, dim)


def build_index(vectors: DataFrame, dim: int, n_blocks: int) -> DataFrame:
    """``block, ids, values, postings``: one row per block of ``vectors``
    (vec_id, v): ids, components, and the numbers of the postings (vector
    times dimensions plus dimension) in impact order."""
    rows = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).cast("int"))

    def run(batches):
        for group in sorted_groups(batches, "block"):
            values = _padded(group.column("v"), dim)
            postings = impact_order(values)
            yield pa.RecordBatch.from_arrays(
                [group.column("block").slice(0, 1), pa.array([group.column("vec_id").to_numpy().tobytes()], pa.binary()),
                 pa.array([_packed(values)], pa.binary()), pa.array([postings.tobytes()], pa.binary())],
                names=["block", "ids", "values", "postings"])

    return materialise(map_arrow(grouped(rows, "block"), run, "block int, ids binary, values binary, postings binary"), "impact-index")


class Block:
    """One block of the index, ready to be searched."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, postings: np.ndarray):
        self.ids, self.values, self.postings = ids, values, postings
        self.middle = (values // STEP * STEP + (STEP - 1) / 2).ravel()[postings]
        self.impact = impact(values).ravel()[postings].astype(float)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every query (ids, scores) of the k best, ties to the smaller
        id, without the vector that has the query's ``own`` id."""
        n, dims = self.values.shape
        able = [self.ids != o for o in own.tolist()]
        if n <= max(PROBES, RESCORE, 2 * k):
            return [self._exact(np.flatnonzero(a), q, k) for a, q in zip(able, queries)]
        found: list = [None] * len(queries)
        open_ = np.arange(len(queries))
        sums = np.zeros((n, len(queries)))
        met = np.zeros((n, len(queries)))      # sizes of the query's components met
        done = 0
        for share in ROUNDS:
            to = n * dims
            if share < 1.0:      # whole segments
                to = int(np.searchsorted(-self.impact, -self.impact[int(share * n * dims)], "right"))
            now = self.postings[done:to]
            part, held = np.zeros(n * dims), np.zeros(n * dims)
            part[now], held[now] = self.middle[done:to], 1.0
            done = to
            q = queries[open_].T.astype(float)
            size = np.abs(q)
            sums += part.reshape(n, dims) @ q
            met += held.reshape(n, dims) @ size
            cut = self.impact[to] if to < n * dims else 0.0
            high = sums + (STEP - 1) / 2 * met + cut * (size.sum(axis=0) - met)
            high += 1e-9 * (1.0 + np.abs(high).max(axis=0))
            still = []
            for c, i in enumerate(open_.tolist()):
                bound = np.where(able[i], high[:, c], -np.inf)
                best = self._exact(np.argpartition(bound, -PROBES)[-PROBES:], queries[i], PROBES, own[i])[1]
                maybe = np.flatnonzero(able[i] & (bound >= best[k - 1])) if len(best) >= k else np.flatnonzero(able[i])
                if len(maybe) <= RESCORE or to == n * dims:
                    found[i] = self._exact(maybe, queries[i], k)
                else:
                    still.append(c)
            if not still:
                break
            open_, sums, met = open_[still], sums[:, still], met[:, still]
        return found

    def _exact(self, rows: np.ndarray, q: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        if own is not None:
            rows = rows[self.ids[rows] != own]
        score = self.values[rows] @ q
        ids = self.ids[rows]
        top = np.lexsort((ids, -score))[:k]
        return ids[top], score[top]


def _best(blocks: list[Block], asked: np.ndarray, number: np.ndarray, queries: np.ndarray, k: int) -> pa.RecordBatch:
    """``query_id, query, vec_id, score``: of several blocks the ``k`` best of
    each query, ties to the smaller id."""
    names, numbers, found, scores = [], [], [], []
    for name, query, each in zip(asked, number, zip(*[b.search(queries, asked, k) for b in blocks])):
        ids, score = (np.concatenate(x) for x in zip(*each))
        top = np.lexsort((ids, -score))[:k]
        names.append(np.full(len(top), name))
        numbers.append(np.full(len(top), query))
        found.append(ids[top])
        scores.append(score[top])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (names, numbers, found, scores)],
                                      names=["query_id", "query", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every query the ``k`` vectors
    of another id with the highest inner products, all if there are fewer;
    ties go to the smaller id.

    ``vectors`` and ``queries``: ``vec_id`` and ``v`` (array<long>).  Null ids
    and null vectors take no part, and rows equal in id and vector are one.
    Several vectors of one id are candidates of their own, so that an id can
    hold several ranks of a query, and queries of their own: ``query_id`` then
    has the ranks from 1 once for each of its vectors, which the columns do
    not tell apart.  Missing components of shorter vectors are 0.  Inner products must fit a long.
    Other columns are not read; empty tables give no rows.
    """
    def once(df: DataFrame) -> DataFrame:
        return df.where("vec_id is not null and v is not null").select("vec_id", "v").distinct()

    every = materialise(once(vectors), "topk-vectors")
    asked = materialise(once(queries).withColumn("query", F.monotonically_increasing_id()), "topk-queries")
    n, dim = every.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dim = max(1, dim, asked.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0])
    n_blocks = max(1, -(-n // ROWS))
    index = build_index(every, dim, n_blocks)
    n_asked = max(1, -(-asked.count() // QUERIES))
    packs = (asked.groupBy(F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(n_asked)).alias("pack"))
             .agg(F.collect_list(F.struct("vec_id", "query", "v")).alias("queries")))       # about QUERIES each
    parts = shuffle_partitions(every.sparkSession)
    span = min(SPAN, max(1, n_blocks // (2 * parts)))      # two units a task, where there are as many blocks
    held = index.select(F.expr(f"block div {span}").alias("unit"), F.lit(-1).cast("long").alias("pack"), "ids", "values", "postings")
    passing = packs.withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n_blocks - 1) // span).cast("long"))))
    # the blocks of a unit come first, its packs behind them
    units = held.unionByName(passing, allowMissingColumns=True).repartition(parts, "unit").sortWithinPartitions("unit", "pack")

    def run(batches):
        unit, blocks = None, []
        for batch in batches:
            for i, (u, number) in enumerate(zip(batch.column("unit").to_pylist(), batch.column("pack").to_pylist())):
                if u != unit:
                    unit, blocks = u, []
                if number < 0:
                    ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                    blocks.append(Block(ids, _unpacked(batch.column("values")[i].as_py(), len(ids), dim),
                                        np.frombuffer(batch.column("postings")[i].as_py(), np.int32)))
                elif blocks:
                    pack = batch.column("queries")[i].values
                    yield _best(blocks, pack.field("vec_id").to_numpy(), pack.field("query").to_numpy(), _padded(pack.field("v"), dim), k)

    best = map_arrow(units.select("unit", "pack", "queries", "ids", "values", "postings"), run, "query_id long, query long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def integer_vectors(vectors: DataFrame, column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``vec_id, v``: ``floor(scale * x)`` of every component; null for vectors
    that are null or hold null or non-finite components."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x"))
    able = finite("x") | (F.size("x") == 0)
    return x.select("vec_id", F.when(able, F.transform("x", lambda c: F.floor(F.lit(scale) * c).cast("long"))).alias("v"))
