"""Histogram trees, boosted and bagged, for many fits at once.

Features are binned once (at most 256 bins each, one byte), and rows with
equal bins and label are one row with a weight: a tree cannot tell them
apart.  A fit is a set of cells (see :mod:`.fits`) and a :class:`TreeSpec`;
all trees of all fits grow in the same Spark jobs.

A node of at most ``LOCAL_ROWS`` such rows is finished by one task.  A larger
one is split by a distributed histogram: every level is one pass that sums
gradients per (fit, tree, node, feature, bin) over Arrow batches, one grouped
aggregate, and the best split of each node, found where its bins are.  Only
splits reach the driver, one row per open node.  Sums are kept in multiples
of 2^-20, so they are exact in any order, and both ways give equal trees for
any partitioning.

Bagging draws a Poisson weight per (tree, row) and the candidate features of a
node from hashes; nothing depends on the order of rows or tasks.

A split sees only the bins, so a fit with many values of ``y`` needs them summed
per row of bins: squared loss once for all rounds (scores are equal where bins
are), a forest once for all trees, after the draws of its rows.  Both sums are
exact, so trees are those of the single rows.
"""

from __future__ import annotations

import io
import pickle
import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .newton import weight
from .ranking import rank_within

LOCAL_ROWS = 100_000
MERGE_ROWS = 10_000
TREES_PER_TASK = 25
MAX_BINS = 256
UNIT = float(1 << 20)


@dataclass(frozen=True)
class TreeSpec:
    """``forest``: bagged trees of ``y``; else boosting with rate ``rate``.
    ``log`` loss (labels 0/1) or squared loss.  ``second_order`` scores splits
    by gradient and curvature with ``l2`` and ``min_curvature`` per side, else by
    the variance of the gradient.  ``some`` features: every node looks at the
    square root of their number."""

    forest: bool
    trees: int
    depth: int | None = None
    rate: float = 1.0
    log: bool = True
    second_order: bool = False
    l2: float = 0.0
    min_curvature: float = 0.0
    some: bool = False
    seed: int = 42


# ---- hashes ----------------------------------------------------------------

def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        h = np.asarray(h, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def row_keys(codes: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        factors = mix(np.arange(codes.shape[1], dtype=np.uint64)) | np.uint64(1)
        return mix((codes.astype(np.uint64) + np.uint64(1)) @ factors + mix((y + 0.0).view(np.uint64)))


def _poisson_table(mean: float) -> np.ndarray:
    top = int(mean + 12 * np.sqrt(mean) + 20)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top + 1)))])
    return np.cumsum(np.exp(np.arange(top + 1) * np.log(mean) - mean - logs))


_POISSON = [_poisson_table(float(1 << j)) for j in range(9)]


def poisson(w: np.ndarray, keys: np.ndarray, tree_key: np.uint64) -> np.ndarray:
    """A Poisson draw of mean ``w`` (a count) for every row: the sum of draws
    for the binary digits of ``w``; from 2^9 on normal draws."""
    out = np.zeros(len(w))
    own = mix(keys ^ tree_key)
    for j in range(int(w.max(initial=0)).bit_length()):
        has = (w >> j) & 1 == 1
        if not has.any():
            continue
        u = (mix(own[has] + np.uint64(j)) >> np.uint64(11)).astype(float) / float(1 << 53)
        if j < len(_POISSON):
            out[has] += np.searchsorted(_POISSON[j], u, "right")
        else:
            v = (mix(own[has] ^ np.uint64(0x5555555555555555 + j)) >> np.uint64(11)).astype(float) / float(1 << 53)
            normal = np.sqrt(-2 * np.log1p(-u)) * np.cos(2 * np.pi * v)
            out[has] += np.maximum(np.rint(2.0 ** j + 2.0 ** (j / 2) * normal), 0)
    return out


def tree_key(spec: TreeSpec, tree: int) -> np.uint64:
    return mix(np.array([spec.seed * 1_000_003 + tree], np.uint64))[0]


# ---- one tree --------------------------------------------------------------

@dataclass
class Tree:
    """Flat arrays; ``feature`` -1 marks a leaf (or a node still open); a row goes
    left if its bin is at most ``bin``."""

    feature: list = field(default_factory=lambda: [-1])
    bin: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])
    gain: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, gain: float) -> int:
        """Children are next to each other; returns the left one."""
        child = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.gain[node] = feature, at, child, gain
        for name, x in (("feature", -1), ("bin", 0), ("left", 0), ("value", 0.0), ("gain", 0.0)):
            getattr(self, name).extend((x, x))
        return child

    def graft(self, node: int, other: "Tree") -> None:
        """Put the root of ``other`` in the place of a leaf."""
        base = len(self.feature) - 1
        for name in ("feature", "bin", "value", "gain"):
            mine, theirs = getattr(self, name), getattr(other, name)
            mine[node] = theirs[0]
            mine.extend(theirs[1:])
        shifted = [x + base for x in other.left]
        self.left[node] = shifted[0]
        self.left.extend(shifted[1:])

    def arrays(self):
        return (np.array(self.feature, np.int32), np.array(self.bin, np.int32), np.array(self.left, np.int64),
                np.array(self.value), np.array(self.gain))

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        feature, at, left, _, _ = self.arrays()
        return _descend(codes, feature, at, left, np.zeros(len(codes), np.int64))


def _descend(codes, feature, at, left, node):
    rows = np.flatnonzero(feature[node] >= 0)
    while len(rows):
        now = node[rows]
        now = left[now] + (codes[rows, feature[now]] > at[now])
        node[rows] = now
        rows = rows[feature[now] >= 0]
    return node


def exact(x: np.ndarray) -> np.ndarray:
    return np.rint(x * UNIT) / UNIT


def candidates(keys: np.ndarray, p: int) -> np.ndarray:
    """A random order of the features for every node key."""
    with np.errstate(over="ignore"):
        return np.argsort(mix(keys[:, None] ^ mix(np.arange(p, dtype=np.uint64))[None, :]), axis=1, kind="stable")


def child_keys(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.stack([keys * np.uint64(2) + np.uint64(1), keys * np.uint64(2) + np.uint64(2)], 1))


def choose(node: np.ndarray, feature: np.ndarray, code: np.ndarray, a: np.ndarray, b: np.ndarray, spec: TreeSpec):
    """Best split per node from summed bins in order of (node, feature, code):
    (nodes with a split, feature, bin, gain).  Ties: smaller feature, then
    smaller bin."""
    if not len(node):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    seg = np.concatenate([[True], (node[1:] != node[:-1]) | (feature[1:] != feature[:-1])])
    first = np.flatnonzero(seg)
    number = np.cumsum(seg) - 1
    ca, cb = np.cumsum(a), np.cumsum(b)
    before_a, before_b = (ca - a)[first][number], (cb - b)[first][number]
    last = np.append(first[1:], len(node)) - 1
    ta, tb = (ca[last][number] - before_a), (cb[last][number] - before_b)
    la, lb = ca - before_a, cb - before_b
    ra, rb = ta - la, tb - lb
    least = max(spec.min_curvature if spec.second_order else 0.0, 1e-12)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = la * la / (lb + spec.l2) + ra * ra / (rb + spec.l2)
        base = ta * ta / (tb + spec.l2)
    gain = np.where((lb >= least) & (rb >= least), score - base, -np.inf)
    nodes = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    best = np.maximum.reduceat(gain, nodes)
    owner = np.repeat(np.arange(len(nodes)), np.diff(np.append(nodes, len(node))))
    at = np.flatnonzero(gain == best[owner])
    at = at[np.unique(owner[at], return_index=True)[1]]
    good = gain[at] > 1e-9 * (1e-3 + np.abs(base[at]))
    at = at[good]
    return node[at], feature[at], code[at], gain[at]


def bins_of(local: np.ndarray, codes: np.ndarray, features: np.ndarray | None, a: np.ndarray, b: np.ndarray, width: int):
    """Sums per (node, feature, code) in that order; ``features`` lists the
    features each node looks at (None: all)."""
    n, p = codes.shape
    if features is None:
        key = (local[:, None] * p + np.arange(p)) * width + codes
    else:
        own = features[local]
        key = (local[:, None] * p + own) * width + np.take_along_axis(codes, own, 1)
    m = key.shape[1]
    key = key.reshape(-1)
    wa, wb = np.repeat(a, m), np.repeat(b, m)
    size = (int(local.max(initial=0)) + 1) * p * width
    if size <= 4 * len(key):
        sa, sb = np.bincount(key, wa, size), np.bincount(key, wb, size)
        key = np.flatnonzero(sb)          # every row's b is positive
        sa, sb = sa[key], sb[key]
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        sa = np.add.reduceat(wa[order], first) if len(key) else np.zeros(0)
        sb = np.add.reduceat(wb[order], first) if len(key) else np.zeros(0)
        key = key[first]
    return key // (p * width), key // width % p, key % width, sa, sb


def _looks(spec: TreeSpec, p: int) -> int | None:
    return max(1, int(np.sqrt(p))) if spec.some else None


def grow(codes: np.ndarray, a: np.ndarray, b: np.ndarray, spec: TreeSpec, key: np.uint64, depth: int = 0) -> tuple[Tree, np.ndarray]:
    """Grow a tree level by level; returns it and the leaf of every row.  Rows
    with ``b`` 0 count nowhere."""
    tree, (n, p) = Tree(), codes.shape
    leaf = np.zeros(n, np.int64)
    width = int(codes.max(initial=0)) + 1
    codes = codes.astype(np.int64)
    rows = np.flatnonzero(b > 0)
    local, nodes, keys = np.zeros(len(rows), np.int64), np.zeros(1, np.int64), np.array([key], np.uint64)
    look = _looks(spec, p)
    while len(rows) and (spec.depth is None or depth < spec.depth):
        found = _level(codes, a, b, rows, local, keys, width, look, spec)
        if not len(found[0]):
            break
        split, feature, at, gain = found
        left = np.array([tree.split(int(nodes[s]), int(f), int(c), float(g)) for s, f, c, g in zip(split, feature, at, gain)], np.int64)
        place = np.full(len(nodes), -1, np.int64)
        place[split] = np.arange(len(split))
        mine = place[local]
        stay = mine >= 0
        rows, mine = rows[stay], mine[stay]
        right = codes[rows, feature[mine]] > at[mine]
        local = 2 * mine + right
        keys = child_keys(keys[split]).reshape(-1)
        nodes = np.stack([left, left + 1], 1).reshape(-1)
        leaf[rows] = nodes[local]
        depth += 1
    return tree, leaf


def _level(codes, a, b, rows, local, keys, width, look, spec):
    """Best splits of all open nodes.  A node without a valid split among its
    candidate features looks at the next ones."""
    p = codes.shape[1]
    if look is None:
        return choose(*bins_of(local, codes[rows], None, a[rows], b[rows], width), spec)
    order = candidates(keys, p)
    parts, open_, start = [], np.ones(len(keys), bool), 0
    while start < p and open_.any():
        mine = open_[local]
        some = rows[mine]
        if not len(some):
            break
        found = choose(*bins_of(local[mine], codes[some], np.sort(order[:, start:start + look], 1), a[some], b[some], width), spec)
        parts.append(found)
        open_[found[0]] = False
        start += look
        # nodes of one distinct row cannot split
        if start < p:
            many = np.zeros(len(keys), np.int64)
            np.add.at(many, local[mine], 1)
            open_ &= many > 1
    out = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4
    order = np.argsort(out[0], kind="stable")
    return tuple(x[order] for x in out)


# ---- gradients -------------------------------------------------------------

def start_value(spec: TreeSpec, total: float, weight: float) -> float:
    if spec.forest:
        return 0.0
    share = total / weight
    if spec.log:
        share = min(max(share, 1e-9), 1 - 1e-9)
        share = np.log(share / (1 - share))
    return float(exact(np.array(share)))


def gradients(spec: TreeSpec, y, w, score, keys, tree: int):
    """(numerator, denominator of a split's score, denominator of a leaf)."""
    if spec.forest:
        drawn = poisson(w, keys, tree_key(spec, tree))
        return exact(drawn * y), drawn, drawn
    if not spec.log:
        return exact(w * (y - score)), w.astype(float), w.astype(float)
    share = 1 / (1 + np.exp(-score))
    curve = exact(w * share * (1 - share))
    return exact(w * (y - share)), curve if spec.second_order else w.astype(float), curve


def set_values(tree: Tree, leaf: np.ndarray, a: np.ndarray, c: np.ndarray, spec: TreeSpec) -> None:
    size = len(tree.feature)
    sa, sc = np.bincount(leaf, a, size), np.bincount(leaf, c, size)
    tree.value = _leaf_values(sa, sc, spec).tolist()


def _leaf_values(sa, sc, spec):
    # a leaf without curvature stays where it is
    under = sc + spec.l2
    return exact(np.where(under > 1e-9, spec.rate * sa / np.where(under > 1e-9, under, 1.0), 0.0))


def boost(codes, y, w, spec: TreeSpec, first: float) -> list[Tree]:
    """All rounds of boosting over the given rows, from the score ``first``."""
    score = np.full(len(y), first)
    keys, out = np.zeros(0, np.uint64), []
    for t in range(spec.trees):
        a, b, c = gradients(spec, y, w, score, keys, t)
        tree, leaf = grow(codes, a, b, spec, tree_key(spec, t))
        set_values(tree, leaf, a, c, spec)
        score = score + np.array(tree.value)[leaf]
        out.append(tree)
    return out


def bag(codes, y, w, spec: TreeSpec, trees: Sequence[int]) -> list[Tree]:
    """The given trees of a forest."""
    keys, out = row_keys(codes, y), []
    for t in trees:
        a, b, _ = gradients(spec, y, w, None, keys, t)
        # draws of 0 leave a row out; the tree's values come from the drawn rows
        rows = np.flatnonzero(b > 0)
        tree, leaf = grow(codes[rows], a[rows], b[rows], spec, tree_key(spec, t))
        set_values(tree, leaf, a[rows], b[rows], spec)
        out.append(tree)
    return out


# ---- compiled ensembles ----------------------------------------------------

@dataclass
class Ensemble:
    """Trees of one model as flat arrays, scored without Spark ML: ``edges`` per
    feature (a value at most ``edges[b]`` lies in bin ``b`` or below)."""

    edges: list
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    roots: np.ndarray
    start: float
    mean: bool
    log: bool

    @classmethod
    def compiled(cls, trees: Sequence[Tree], edges, spec: TreeSpec, start: float) -> "Ensemble":
        arrays = [t.arrays() for t in trees]
        sizes = np.array([len(x[0]) for x in arrays], np.int64)
        roots = np.cumsum(sizes) - sizes
        join = lambda i: np.concatenate([x[i] for x in arrays])
        left = np.concatenate([x[2] + r for x, r in zip(arrays, roots)])
        return cls(list(edges), join(0).astype(np.int16), join(1).astype(np.int16), left.astype(np.int32), join(3),
                   join(4).astype(np.float32), roots, start, spec.forest, spec.log and not spec.forest)

    def raw(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        for a in range(0, len(codes), 1024):
            some = codes[a:a + 1024]
            n, t = len(some), len(self.roots)
            node = np.tile(self.roots, n)
            wide = np.repeat(np.arange(n), t)
            live = np.flatnonzero(self.feature[node] >= 0)
            while len(live):
                now = node[live]
                now = self.left[now] + (some[wide[live], self.feature[now]] > self.bin[now])
                node[live] = now
                live = live[self.feature[now] >= 0]
            sums = self.value[node].reshape(n, t).sum(1)
            out[a:a + n] = sums / t if self.mean else self.start + sums
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1, or the predicted value."""
        raw = self.raw(binned(x, self.edges))
        return 1 / (1 + np.exp(-raw)) if self.log else raw

    def importance(self) -> np.ndarray:
        """Share of each feature in the gain, per tree and then averaged."""
        out, n = np.zeros(len(self.edges)), 0
        for a, b in zip(self.roots, [*self.roots[1:], len(self.feature)]):
            inner = self.feature[a:b] >= 0
            own = np.bincount(self.feature[a:b][inner], self.gain[a:b][inner], len(out))
            if own.sum() > 0:
                out, n = out + own / own.sum(), n + 1
        return out / n if n else out

    def to_bytes(self) -> bytes:
        """The arrays as one compressed file."""
        out = io.BytesIO()
        np.savez_compressed(out, edges=np.concatenate([np.zeros(0), *self.edges]), sizes=np.array([len(e) for e in self.edges], np.int64),
                            kind=np.array([self.start, self.mean, self.log]), **{k: getattr(self, k) for k in self._ARRAYS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, blob: bytes) -> "Ensemble":
        z = np.load(io.BytesIO(blob), allow_pickle=False)
        edges = np.split(z["edges"], np.cumsum(z["sizes"])[:-1]) if len(z["sizes"]) else []
        start, mean, log = z["kind"].tolist()
        return cls(edges, *(z[k] for k in cls._ARRAYS), start, bool(mean), bool(log))

    _ARRAYS = ("feature", "bin", "left", "value", "gain", "roots")


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    out = np.zeros(x.shape, np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.searchsorted(e, x[:, i], "left")
    return out


# ---- Spark -----------------------------------------------------------------

def edges_of(df: DataFrame, columns: Sequence[str], bins: int = MAX_BINS) -> list[np.ndarray]:
    """Upper edges of at most ``bins`` bins per column: midpoints of its
    distinct values if there are few, else exact quantiles.  At most ``bins``
    rows per column reach the driver."""
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(columns)])).alias("e")
    counted = df.select(values, weight(df).alias("w")).select("e.i", "e.v", "w").groupBy("i", "v").agg(F.sum("w").alias("c")).checkpoint()
    kinds = {r["i"]: r["k"] for r in counted.groupBy("i").agg(F.count(F.lit(1)).alias("k")).collect()}
    few = [i for i, k in kinds.items() if k <= bins]
    edges = [np.zeros(0)] * len(columns)
    small: dict[int, list] = {i: [] for i in few}
    for r in counted.where(F.col("i").isin(few)).collect():
        small[r["i"]].append(r["v"])
    for i, v in small.items():
        v = np.sort(np.array(v, float))
        edges[i] = (v[1:] + v[:-1]) / 2
    many = [i for i in kinds if i not in small]
    if many:
        ranked = rank_within(counted.where(F.col("i").isin(many)), ["i"], [F.col("v").asc()], sums=["c"])
        step = lambda c: F.floor(c * F.lit(bins) / F.col("_tot_c"))
        cuts = ranked.where((step(F.col("_cum_c")) > step(F.col("_cum_c") - F.col("c"))) & (F.col("_cum_c") < F.col("_tot_c")))
        found: dict[int, list] = {i: [] for i in many}
        for r in cuts.select("i", "v").collect():
            found[r["i"]].append(r["v"])
        for i, v in found.items():
            edges[i] = np.sort(np.array(v, float))[:bins - 1]
    return edges


def distinct_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of one of each distinct row, and for every row its place among them."""
    if not x.shape[1] or not len(x):
        return np.zeros(min(1, len(x)), np.int64), np.zeros(len(x), np.int64)
    bits = x.astype(np.uint64) if x.dtype == np.uint8 else np.ascontiguousarray(x).view(np.uint64)
    with np.errstate(over="ignore"):
        h = mix(bits @ (mix(np.arange(x.shape[1], dtype=np.uint64)) | np.uint64(1)))
    _, first, at = np.unique(h, return_index=True, return_inverse=True)
    if not np.array_equal(bits[first][at], bits):          # two rows of one hash
        _, first, at = np.unique(bits, axis=0, return_index=True, return_inverse=True)
    return first, at.reshape(-1)


def _chunks(batches, rows: int = 100_000):
    """Arrow batches brought together to tables of about ``rows`` rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _columns(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names]) if names else np.zeros((batch.num_rows, 0))


def _weighted(df: DataFrame, columns: Sequence[str], edges: list) -> DataFrame:
    """``_cell, _x, _y, _w``: binned rows (a byte per feature) with weights."""
    names = list(columns)

    def run(batches):
        for batch in batches:
            codes = binned(_columns(batch, names), edges)
            x = pa.array([r.tobytes() for r in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_cell"), x, batch.column("_y"), batch.column("_w")], names=["_cell", "_x", "_y", "_w"])

    coded = df.select("_cell", "_y", weight(df).alias("_w"), *names).mapInArrow(run, "_cell int, _x binary, _y double, _w long")
    return coded.groupBy("_cell", "_x", "_y").agg(F.sum("_w").alias("_w"))


def _arrays(table, p: int):
    """(codes, y, w) of weighted rows in one order whatever their order was."""
    x = table.column("_x").to_pylist()
    y, w = table.column("_y").to_numpy(), table.column("_w").to_numpy()
    codes = np.frombuffer(b"".join(x), np.uint8).reshape(len(x), p)
    order = np.lexsort((y, *codes.T[::-1])) if len(x) else np.zeros(0, np.int64)
    return codes[order], y[order], w[order]


def fit_trees(df: DataFrame, columns: Sequence[str], fits: Mapping, jobs: Sequence[tuple]) -> list[Ensemble]:
    """One ensemble per job ``(fit, TreeSpec)``.  ``df`` has ``_cell``, ``_y`` and the
    feature ``columns`` (doubles without nulls), and ``_w`` where a row stands for
    several; ``fits`` names the cells of each
    fit's training rows.  What reaches the driver is bounded by the number of
    bins, fits and nodes of the fitted trees.  A fit without rows is an error."""
    spark, p = df.sparkSession, len(columns)
    ship(spark)
    edges = edges_of(df, columns)
    names = list(dict.fromkeys(f for f, _ in jobs))
    pairs = [(int(c), names.index(f)) for f in names for c in fits[f]]
    cells = spark.createDataFrame(pairs or [(0, 0)], "_cell int, _fit int").limit(len(pairs))
    rows = (_weighted(df, columns, edges).join(cells, "_cell").groupBy("_fit", "_x", "_y")
            .agg(F.sum("_w").alias("_w")).checkpoint())
    size = {r["_fit"]: r for r in rows.groupBy("_fit").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_y")).alias("t")).collect()}
    missing = [names[i] for i in range(len(names)) if i not in size]
    if missing:
        raise ValueError(f"no training rows for {missing}")
    numbered = [(j, names.index(f), spec) for j, (f, spec) in enumerate(jobs)]
    start = {j: start_value(spec, size[f]["t"], size[f]["w"]) for j, f, spec in numbered}
    rows_of = {j: size[f]["n"] for j, f, _ in numbered}
    # fits whose values are worth summing per row of bins
    merge = [x for x in numbered if rows_of[x[0]] > min(MERGE_ROWS, LOCAL_ROWS) and (x[2].forest or not x[2].log)]
    trees: dict[int, list[Tree]] = {}
    if merge:
        summed = _summed(rows.where(F.col("_fit").isin(sorted({f for _, f, _ in merge})))).checkpoint()
        bins = {r["_fit"]: r["n"] for r in summed.groupBy("_fit").agg(F.count(F.lit(1)).alias("n")).collect()}
        squared = [x for x in merge if not x[2].forest]
        trees |= _fit_local(summed, [x for x in squared if bins[x[1]] <= LOCAL_ROWS], p, start)
        trees |= _fit_levels(summed, [x for x in squared if bins[x[1]] > LOCAL_ROWS], p, start)
        trees |= _fit_drawn(rows, [x for x in merge if x[2].forest and bins[x[1]] <= min(LOCAL_ROWS, rows_of[x[0]] // 4)], p)
    rest = [x for x in numbered if x[0] not in trees]
    trees |= _fit_local(rows, [x for x in rest if rows_of[x[0]] <= LOCAL_ROWS], p, start)
    trees |= _fit_levels(rows, [x for x in rest if rows_of[x[0]] > LOCAL_ROWS], p, start)
    return [Ensemble.compiled(trees[j], edges, spec, start[j]) for j, _, spec in numbered]


def _summed(rows: DataFrame) -> DataFrame:
    """``rows`` with equal bins together: their weight, and as ``_y`` the mean of
    their values in whole units, which gives back the sum of their gradients."""
    total = F.sum(F.rint(F.col("_w") * F.col("_y") * F.lit(UNIT))) / F.lit(UNIT)
    return rows.groupBy("_fit", "_x").agg((total / F.sum("_w")).alias("_y"), F.sum("_w").alias("_w"))


def _fit_drawn(rows: DataFrame, jobs: list, p: int) -> dict[int, list[Tree]]:
    """Forests of many rows but few rows of bins: one pass draws the weights of
    all trees and sums them per row of bins, then a task grows each tree."""
    if not jobs:
        return {}
    specs = {j: spec for j, _, spec in jobs}

    def draws(batches):
        for table in _chunks(batches):
            fit, x = table.column("_fit").to_numpy(), table.column("_x").to_pylist()
            ys, ws = table.column("_y").to_numpy(), table.column("_w").to_numpy()
            every = np.frombuffer(b"".join(x), np.uint8).reshape(len(x), p)
            for j, f, spec in jobs:
                mine = np.flatnonzero(fit == f)
                if not len(mine):
                    continue
                codes, y, w = every[mine], ys[mine], ws[mine]
                first, at = distinct_rows(codes)
                names = [r.tobytes() for r in codes[first]]
                keys = row_keys(codes, y)
                for t in range(spec.trees):
                    a, b, _ = gradients(spec, y, w, None, keys, t)
                    sa, sb = np.bincount(at, a, len(first)), np.bincount(at, b, len(first))
                    use = np.flatnonzero(sb > 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(use), j, np.int32)), pa.array(np.full(len(use), t, np.int32)),
                         pa.array([names[i] for i in use], pa.binary()), pa.array(sa[use]), pa.array(sb[use])], names=["job", "tree", "x", "a", "b"])

    def finish(key, table):
        job, t = (x.as_py() for x in key)
        x = table.column("x").to_pylist()
        codes = np.frombuffer(b"".join(x), np.uint8).reshape(len(x), p)
        a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
        tree, leaf = grow(codes, a, b, specs[job], tree_key(specs[job], t))
        set_values(tree, leaf, a, b, specs[job])
        return pa.table({"job": pa.array([job], pa.int32()), "tree": pa.array([t], pa.int32()),
                         "blob": pa.array([zlib.compress(pickle.dumps(tree, protocol=5), 1)], pa.binary())})

    wanted = rows.where(F.col("_fit").isin(sorted({f for _, f, _ in jobs})))
    added = wanted.mapInArrow(draws, "job int, tree int, x binary, a double, b double").groupBy("job", "tree", "x").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"))
    done = added.groupBy("job", "tree").applyInArrow(finish, "job int, tree int, blob binary").collect()      # the fitted trees
    found = {(r["job"], r["tree"]): pickle.loads(zlib.decompress(r["blob"])) for r in done}
    # a tree whose rows were all left out is one leaf
    return {j: [found.get((j, t)) or Tree() for t in range(spec.trees)] for j, _, spec in jobs}


def _fit_local(rows: DataFrame, jobs: list, p: int, start: dict) -> dict[int, list[Tree]]:
    """Fits whose rows one task can hold: a task per boosted model and per
    ``TREES_PER_TASK`` trees of a forest."""
    if not jobs:
        return {}
    spark = rows.sparkSession
    specs = {j: spec for j, _, spec in jobs}
    parts = [(f, j, c) for j, f, spec in jobs for c in range(-(-spec.trees // TREES_PER_TASK) if spec.forest else 1)]
    tasks = spark.createDataFrame(parts, "_fit int, job int, part int")

    def run(key, table):
        job, part = key[0].as_py(), key[1].as_py()
        spec = specs[job]
        codes, y, w = _arrays(table, p)
        if spec.forest:
            found = bag(codes, y, w, spec, range(part * TREES_PER_TASK, min(spec.trees, (part + 1) * TREES_PER_TASK)))
        else:
            found = boost(codes, y, w, spec, start[job])
        return pa.table({"job": pa.array([job], pa.int32()), "part": pa.array([part], pa.int32()),
                         "blob": pa.array([zlib.compress(pickle.dumps(found, protocol=5), 1)], pa.binary())})

    grouped = rows.join(F.broadcast(tasks), "_fit").repartition(3 * len(parts), "job", "part").groupBy("job", "part")
    done = grouped.applyInArrow(run, "job int, part int, blob binary").collect()      # the fitted trees
    out: dict[int, list[Tree]] = {}
    for r in sorted(done, key=lambda r: (r["job"], r["part"])):
        out.setdefault(r["job"], []).extend(pickle.loads(zlib.decompress(r["blob"])))
    return out


_BINS = "job int, tree int, node int, feature int, code int, a double, b double"


def _fit_levels(rows: DataFrame, jobs: list, p: int, start: dict) -> dict[int, list[Tree]]:
    """Fits beyond ``LOCAL_ROWS``: one pass over all rows per level, for all of
    them together.  Boosting: scores are recomputed from the trees so far,
    so no state has to survive between passes.  Forests: nodes that have
    become small are finished by one task each."""
    done: dict[int, list[Tree]] = {j: [] for j, _, _ in jobs}
    forests = [x for x in jobs if x[2].forest]
    if forests:
        grown = {(j, t): Tree() for j, _, spec in forests for t in range(spec.trees)}
        _grow_levels(rows, forests, p, start, {}, grown, LOCAL_ROWS)
        for j, _, spec in forests:
            done[j] = [grown[j, t] for t in range(spec.trees)]
    boosted = [x for x in jobs if not x[2].forest]
    for t in range(max((spec.trees for _, _, spec in boosted), default=0)):
        now = [x for x in boosted if t < x[2].trees]
        grown = {(j, t): Tree() for j, _, _ in now}
        _grow_levels(rows, now, p, start, done, grown, 0)
        for j, _, _ in now:
            done[j].append(grown[j, t])
    return done


def _pass(rows: DataFrame, jobs: list, p: int, start: dict, done: dict, grown: dict, emit, schema: str) -> DataFrame:
    """Run ``emit(job, tree, spec, codes, y, w, a, b, c, leaf)`` for every batch,
    job and growing tree; it returns columns without job and tree."""
    names = [x.split(" ")[0] for x in schema.split(", ")]
    so_far = {j: Ensemble.compiled(done[j], [], spec, start[j]) for j, _, spec in jobs if done.get(j)}
    types = {"int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "long": pa.int64()}
    kinds = [types[x.split(" ")[1]] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            fit = batch.column("_fit").to_numpy()
            x = batch.column("_x").to_pylist()
            every = np.frombuffer(b"".join(x), np.uint8).reshape(len(x), p)
            ys, ws = batch.column("_y").to_numpy(), batch.column("_w").to_numpy()
            for j, f, spec in jobs:
                mine = np.flatnonzero(fit == f)
                if not len(mine):
                    continue
                codes, y, w = every[mine], ys[mine], ws[mine]
                score = so_far[j].raw(codes) if j in so_far else np.full(len(mine), start[j])
                keys = row_keys(codes, y) if spec.forest else np.zeros(0, np.uint64)
                for (job, t), tree in grown.items():
                    if job != j:
                        continue
                    a, b, c = gradients(spec, y, w, score, keys, t)
                    found = emit(job, t, spec, codes, y, w, a, b, c, tree.leaves(codes))
                    if found is not None and len(found[0]):
                        n = len(found[0])
                        cols = [np.full(n, job, np.int32), np.full(n, t, np.int32), *found]
                        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)], names=names)

    return rows.mapInArrow(run, schema)


_SPLITS = "job int, tree int, node int, feature int, code int, gain double, weight double"


def _best_split(specs: dict, open_: dict, p: int):
    """Best split of one node from its summed bins; ``open_`` holds the nodes' keys."""
    def split(key, table):
        job, t, node = (x.as_py() for x in key)
        spec = specs[job]
        f, c = table.column("feature").to_numpy(), table.column("code").to_numpy()
        order = np.lexsort((c, f))
        f, c = f[order].astype(np.int64), c[order].astype(np.int64)
        a, b = table.column("a").to_numpy()[order], table.column("b").to_numpy()[order]
        look = _looks(spec, p)
        turns = [np.arange(p)]
        if look is not None:
            ranked = candidates(np.array([open_[job, t][node]], np.uint64), p)[0]
            turns = [ranked[i:i + look] for i in range(0, p, look)]
        found = None
        for some in turns:
            use = np.isin(f, some)
            found = choose(np.zeros(int(use.sum()), np.int64), f[use], c[use], a[use], b[use], spec)
            if len(found[0]):
                break
        best = [found[1][0], found[2][0], found[3][0]] if len(found[0]) else [-1, 0, 0.0]
        row = [job, t, node, int(best[0]), int(best[1]), float(best[2]), float(b[f == f[0]].sum())]
        kinds = [pa.int32()] * 5 + [pa.float64()] * 2
        return pa.table({x.split(" ")[0]: pa.array([v], k) for x, v, k in zip(_SPLITS.split(", "), row, kinds)})

    return split


def _grow_levels(rows, jobs, p, start, done, grown, finish: int) -> None:
    """Grow the trees ``grown`` in place: levels by distributed histograms until
    no node splits or every open node has at most ``finish`` rows."""
    specs = {j: spec for j, _, spec in jobs}
    open_ = {k: {0: tree_key(specs[k[0]], k[1])} for k in grown}      # node -> key
    small: dict = {k: {} for k in grown}
    depth = 0
    while any(open_.values()):
        def histogram(job, t, spec, codes, y, w, a, b, c, leaf, open_=open_):
            nodes = np.array(sorted(open_[job, t]), np.int64)
            if not len(nodes):
                return None
            local = np.searchsorted(nodes, leaf)
            use = (local < len(nodes)) & (nodes[np.minimum(local, len(nodes) - 1)] == leaf) & (b > 0)
            if not use.any():
                return None
            node, feature, code, sa, sb = bins_of(local[use], codes[use].astype(np.int64), None, a[use], b[use], MAX_BINS)
            return nodes[node], feature, code, sa, sb

        summed = _pass(rows, jobs, p, start, done, grown, histogram, _BINS).groupBy("job", "tree", "node", "feature", "code").agg(
            F.sum("a").alias("a"), F.sum("b").alias("b"))
        best = summed.groupBy("job", "tree", "node").applyInArrow(_best_split(specs, open_, p), _SPLITS).collect()
        ahead: dict = {k: {} for k in grown}
        for r in sorted(best, key=lambda r: (r["job"], r["tree"], r["node"])):
            k, key = (r["job"], r["tree"]), open_[r["job"], r["tree"]][r["node"]]
            spec = specs[r["job"]]
            if finish and r["weight"] <= finish:
                small[k][r["node"]] = (key, depth)
            elif r["feature"] >= 0 and (spec.depth is None or depth < spec.depth):
                left = grown[k].split(r["node"], r["feature"], r["code"], r["gain"])
                ahead[k] |= dict(zip((left, left + 1), child_keys(np.array([key], np.uint64))[0]))
        open_, depth = ahead, depth + 1
        if not finish and all(s.depth is not None and depth >= s.depth for s in specs.values()):
            break
    _finish(rows, jobs, p, start, done, grown, small)


def _finish(rows, jobs, p, start, done, grown, small) -> None:
    """Leaf values by one more pass; the subtrees of small nodes by one task each."""
    specs = {j: spec for j, _, spec in jobs}
    nodes_of = {k: np.array(sorted(v), np.int64) for k, v in small.items()}

    def leaves(job, t, spec, codes, y, w, a, b, c, leaf):
        node, at = np.unique(leaf[b > 0], return_inverse=True)
        return node, np.bincount(at, a[b > 0], len(node)), np.bincount(at, c[b > 0], len(node))

    sums = _pass(rows, jobs, p, start, done, grown, leaves, "job int, tree int, node int, a double, b double").groupBy(
        "job", "tree", "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    for r in sums:
        value = _leaf_values(np.array([r["a"]]), np.array([r["b"]]), specs[r["job"]])[0]
        grown[r["job"], r["tree"]].value[r["node"]] = float(value)
    if not any(len(v) for v in nodes_of.values()):
        return

    def members(job, t, spec, codes, y, w, a, b, c, leaf):
        use = np.isin(leaf, nodes_of[job, t]) & (b > 0)
        return leaf[use], [r.tobytes() for r in codes[use]], a[use], b[use]

    def finish(key, table):
        job, t, node = (x.as_py() for x in key)
        x = table.column("x").to_pylist()
        codes = np.frombuffer(b"".join(x), np.uint8).reshape(len(x), p)
        a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
        own, depth = small[job, t][node]
        tree, leaf = grow(codes, a, b, specs[job], np.uint64(own), depth)
        set_values(tree, leaf, a, b, specs[job])
        return pa.table({"job": pa.array([job], pa.int32()), "tree": pa.array([t], pa.int32()), "node": pa.array([node], pa.int32()),
                         "blob": pa.array([zlib.compress(pickle.dumps(tree, protocol=5), 1)], pa.binary())})

    found = _pass(rows, jobs, p, start, done, grown, members, "job int, tree int, node int, x binary, a double, b double").groupBy(
        "job", "tree", "node").applyInArrow(finish, "job int, tree int, node int, blob binary").collect()
    for r in sorted(found, key=lambda r: (r["job"], r["tree"], r["node"])):
        grown[r["job"], r["tree"]].graft(r["node"], pickle.loads(zlib.decompress(r["blob"])))
