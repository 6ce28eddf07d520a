"""Embedding near-dedup with spherical-cap filters (Becker, Ducas, Gama &
Laarhoven 2016).

Filter directions form structured random product codes: after a random
rotation a vector is cut into ``m`` blocks, each block has its own code of
random unit vectors, and a direction is one code word per block.  A vector
passes a filter if the sum of its blocks' inner products reaches a threshold;
list decoding enumerates exactly those directions, block by block, pruning
with the best that later blocks can add.  Vectors meet in the filters they
share.

Within a filter pairs are first compared on eight-bit copies with their
exact rounding error, which cannot lose a pair, and the members left are
verified in double precision.  A pair counts in the smallest filter both
pass.  Filters are cut into blocks, so that a common vector is spread over
tasks, and equal vectors are one class, handled once.

The number of directions grows with the number of vectors and the threshold
with it, so a filter holds about ``LIST`` / ``SPARSE`` unrelated vectors at
any size.  A vector whose length is spread unevenly over the blocks passes
few filters of a code, so there are several codes with rotations of their
own: as many as it takes for a pair at the threshold to share no filter with
a probability of at most ``MISS``, by simulated pairs of each code.  In 64
dimensions and at a cosine of 0.95 that is (product of the codes' simulated
misses; closer pairs are safer):

    vectors   blocks   codes   miss      miss of the first five codes
    2 000     2        5       2.2e-5    2.2e-5
    10 000    2        5       1.9e-5    1.9e-5
    100 000   2        6       1.9e-5    1.0e-4
    1 M       2        7       1.5e-5    3.7e-4
    16 M      2        7       2.7e-5    6.9e-4
    17 M      3        16      1.9e-5    2.9e-2
    50 M      3        15      1.9e-5    1.7e-2
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forest, grouped, in_blocks, map_arrow, materialise, not_broadcast, sorted_groups

THRESHOLD = 0.95
CODES = 5              # independent product codes, at least
MISS = 3e-5            # probability that a pair at the threshold shares no filter
PAIRS = 512            # simulated for each code to know when that is reached
LIST = 24              # filters a vector passes in each, on average
SPARSE = 64            # directions per vector in each
THREE_BLOCKS = 1 << 24  # vectors from which directions have three blocks
BLOCK = 512
SEED = 64


class ProductCode:
    """One code for vectors of one dimension: rotation, blocks, threshold."""

    def __init__(self, dim: int, n: int, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.dim = dim
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        m = min(dim, 2 if n < THREE_BLOCKS else 3)
        edges = np.linspace(0, dim, m + 1).astype(int)
        self.blocks = [slice(a, b) for a, b in zip(edges, edges[1:])]
        per_block = max(16, math.ceil((SPARSE * max(n, 1)) ** (1 / m)))
        self.codes = []
        for s in self.blocks:
            width = s.stop - s.start
            # few distinct directions exist in very few dimensions
            size = min(per_block, 2 * 4 ** min(width - 1, 15))
            c = rng.standard_normal((size, width))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True))
        self.total = math.prod(len(c) for c in self.codes)
        self.threshold = -np.inf if 2 * LIST >= self.total else self._calibrated(rng)

    def _calibrated(self, rng) -> float:
        """Threshold at which random vectors pass ``LIST`` filters on average,
        from the best sums of their best code words."""
        trials, most = 64, 32 * LIST
        pooled = []
        for v in rng.standard_normal((trials, self.dim)):
            v /= np.linalg.norm(v)
            sums = np.zeros(1)
            for s, c in zip(self.blocks, self.codes):
                x = np.sort(c @ v[s])[-1024:]
                sums = (sums[:, None] + x).ravel()
                if len(sums) > most:
                    sums = np.partition(sums, -most)[-most:]
            pooled.append(sums)
        pooled = np.concatenate(pooled)
        return float(np.partition(pooled, -trials * LIST)[-trials * LIST])

    def decode(self, units: np.ndarray) -> list[np.ndarray]:
        """For every unit vector the sorted numbers of its filters."""
        r = units @ self.rotation
        scores = [r[:, s] @ c.T for s, c in zip(self.blocks, self.codes)]
        best = [x.max(axis=1) for x in scores]
        out = []
        for i in range(len(units)):
            number, got = np.zeros(1, np.int64), np.zeros(1)
            for k, x in enumerate(scores):
                rest = sum(b[i] for b in best[k + 1:])
                # code words that can still reach the threshold at all
                word = np.flatnonzero(x[i] + got.max() + rest >= self.threshold)
                both = got[:, None] + x[i, word]
                a, b = np.nonzero(both + rest >= self.threshold)
                number = number[a] * len(self.codes[k]) + word[b]
                got = both[a, b]
                if not len(number):
                    break
            out.append(np.sort(number))
        return out


def missed(code: ProductCode, threshold: float) -> float:
    """Probability that two vectors with a cosine of ``threshold`` share no
    filter of ``code``: the share among simulated pairs, one more counted on
    either side."""
    rng = np.random.default_rng([SEED, code.dim])
    lost = 0
    for _ in range(0, PAIRS, 64):      # few scores at a time
        u, w = unit_rows(rng.standard_normal((64, code.dim))), rng.standard_normal((64, code.dim))
        w -= (u * w).sum(axis=1, keepdims=True) * u
        if code.dim > 1:
            w = unit_rows(w)
        v = threshold * u + math.sqrt(max(0.0, 1 - threshold * threshold)) * w
        lost += sum(not len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(code.decode(u), code.decode(unit_rows(v))))
    return (lost + 1) / (PAIRS + 2)


def codes_for(dim: int, n: int, threshold: float = THRESHOLD) -> list[ProductCode]:
    """As many codes as it takes for ``MISS``, at least ``CODES``: more for
    more vectors, for three blocks and for a smaller threshold."""
    codes, miss = [], 1.0
    while len(codes) < CODES or miss > MISS:
        codes.append(ProductCode(dim, n, SEED + len(codes)))
        miss *= missed(codes[-1], threshold)
    return codes


_codes: dict[tuple[int, int, float], list[ProductCode]] = {}


def filters_of(units: np.ndarray, n: int, threshold: float = THRESHOLD) -> list[np.ndarray]:
    """The sorted filters of unit vectors, over all codes."""
    key = (units.shape[1], n, threshold)
    if key not in _codes:
        if len(_codes) > 8:
            _codes.clear()
        _codes[key] = codes_for(*key)
    lists = [code.decode(units) for code in _codes[key]]
    total = _codes[key][0].total
    return [np.concatenate([x + i * total for i, x in enumerate(each)]) for each in zip(*lists)]


def finite(column: str) -> Column:
    """A vector with components, all of them finite numbers."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & ~bad, F.lit(False))


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow."""
    x = values / np.abs(values).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _decoded(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """``node, dim, size, v, filters, q, eps``: filters, eight-bit copy and
    its rounding error of every class."""
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                for a in range(0, some.num_rows, 1024):
                    part = some.slice(a, 1024)
                    units = unit_rows(matrix(part.column("v"), int(dim)))
                    lists = filters_of(units, n, threshold)
                    scale = np.abs(units).max(axis=1, keepdims=True) / 127
                    q = np.rint(units / scale).astype(np.int8)
                    copy = q * scale
                    eps = np.sqrt(((units - copy) ** 2).sum(axis=1))
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists))),
                         pa.array([x.tobytes() for x in q], pa.binary()), pa.array(scale[:, 0]), pa.array(eps)],
                        names=[*part.schema.names, "filters", "q", "scale", "eps"])

    return map_arrow(classes.select("node", "dim", "size", "v"), run,
                     "node long, dim int, size long, v array<double>, filters array<long>, q binary, scale double, eps double")


_UNIT = "g long, dim int, filter long, bi int, bj int, own int, node long"


def _meeting(group: pa.RecordBatch, n: int) -> np.ndarray:
    """Pairs whose two blocks meet in this unit of work."""
    own = group.column("own").to_numpy()
    ok = np.triu(np.ones((n, n), bool), 1)
    if group.column("bi")[0].as_py() != group.column("bj")[0].as_py():
        ok &= own[:, None] != own
    return ok


def _near(rows: DataFrame, threshold: float) -> DataFrame:
    """Of every unit of work keep members that may reach the threshold."""
    def run(batches):
        for group in sorted_groups(batches, "g", "filter"):
            n = group.num_rows
            if n < 2:
                continue
            x = np.frombuffer(b"".join(group.column("q").to_pylist()), np.int8).reshape(n, -1) * group.column("scale").to_numpy()[:, None]
            eps = group.column("eps").to_numpy()
            # |u.v - x.y| <= eps_u + eps_v + eps_u * eps_v, and some for rounding
            may = x @ x.T + eps[:, None] + eps + eps[:, None] * eps >= threshold - 1e-9
            may &= _meeting(group, n)
            useful = may.any(axis=0) | may.any(axis=1)
            if useful.any():
                yield group.select(_names).filter(pa.array(useful))

    _names = [f.split()[0] for f in _UNIT.split(", ")]
    return map_arrow(rows, run, _UNIT)


def _linked(rows: DataFrame, threshold: float) -> DataFrame:
    """Cosines in double precision; a pair counts in its smallest filter."""
    def run(batches):
        for group in sorted_groups(batches, "g", "filter"):
            n = group.num_rows
            if n < 2:
                continue
            u = unit_rows(matrix(group.column("v"), group.column("dim")[0].as_py()))
            near = (u @ u.T >= threshold) & _meeting(group, n)
            a, b = np.nonzero(near)
            if not len(a):
                continue
            here = group.column("filter")[0].as_py()
            lists = [x.values.to_numpy() for x in group.column("filters")]
            # filters below this one, numbered to test all pairs at once
            lower = [x[:np.searchsorted(x, here)] for x in lists]
            known = np.unique(np.concatenate(lower))
            if len(known):
                held = np.zeros((n, len(known)), np.float32)
                for i, x in enumerate(lower):
                    held[i, np.searchsorted(known, x)] = 1
                first = (held @ held.T)[a, b] == 0
                a, b = a[first], b[first]
            if not len(a):
                continue
            size = group.column("size").to_numpy()
            links = np.zeros(n, np.int64)
            np.add.at(links, a, size[b])
            np.add.at(links, b, size[a])
            node = group.column("node").to_numpy()
            root, keep = forest(n, a, b), np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(links[keep]), pa.array(node[root[keep]])],
                                             names=["node", "links", "other"])

    return map_arrow(rows, run, "node long, links long, other long")


def embedding_links(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Two vectors are linked if their cosine, in double precision, is at least
    ``threshold``.  ``n_links`` counts the other vectors linked directly,
    ``component_id`` is the smallest id reachable by links, itself included,
    and ``kept`` tells whether that is the row's own.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do vectors of different dimensions with each
    other.  A null id takes no part: 0 links, null component, kept.  Rows
    repeated with id and vector count as one vector, equal vectors under
    several ids are linked.  Other columns are not read; an empty table
    gives no rows.
    """
    src = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    able = finite("v") & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = src.withColumn("v", F.when(able, F.col("v"))).select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    usable = rows.where("v is not null")
    sizes = usable.select("h1", "h2", "vec_id").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("size"))
    classes = materialise(usable.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.first("v").alias("v"))
                          .join(sizes, ["h1", "h2"]).withColumn("dim", F.size("v")).withColumn("node", F.monotonically_increasing_id()),
                          "vector-classes")
    n = classes.count()
    decoded = materialise(_decoded(classes, n, threshold), "vector-filters")
    passed = decoded.select("node", "dim", F.explode("filters").alias("filter"))
    shared = passed.groupBy("dim", "filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    units = (in_blocks(not_broadcast(passed).join(shared, ["dim", "filter"]), "n", BLOCK, "node")
             .withColumn("g", F.xxhash64("dim", "filter", "bi", "bj")).drop("n"))
    near = materialise(_near(grouped(not_broadcast(units).join(decoded.select("node", "q", "scale", "eps"), "node"), "g", "filter"), threshold), "vector-near")
    found = materialise(_linked(grouped(not_broadcast(near).join(decoded.select("node", "size", "v", "filters"), "node"), "g", "filter"), threshold), "vector-links")
    # every node has its class; the components, read from a compressed file, are never broadcast to the left of an outer join
    component = connected_components(found.select("node", "other"), "node", "other").join(classes.select("node", "rep"), "node", "left")
    smallest = component.groupBy("component").agg(F.min("rep").alias("c"))
    per_node = (component.join(smallest, "component").select("node", "c")
                .join(found.groupBy("node").agg(F.sum("links").alias("links")), "node"))
    known = (classes.select("node", "h1", "h2", "rep", "size").join(per_node, "node", "left")
             .select("h1", "h2", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("c", "rep").alias("c")))
    out = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.col("h1")).alias("h1"), "h2").join(known, ["h1", "h2"], "left")
    return (out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True))))
