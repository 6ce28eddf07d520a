"""N-gram Jaccard join: a MinHash LSH forest (Bawa, Condie & Ganesan 2005)
followed by exact verification.

Every text becomes the set of its five-word shingles (a text of one to four
words is one shingle) and a signature of ``TREES * MAX_DEPTH`` minimum
hashes, two bytes each.  Tree ``t`` is the sorted trie of the branches
``signature[t * MAX_DEPTH : (t + 1) * MAX_DEPTH]``.  Matching starts with
whole branches and shortens the matched prefix of one tree at a time, always
where the trie says a step adds the fewest candidate pairs for the recall it
brings, until two sets at the threshold are found with the target
probability.

Candidates share a prefix in some tree.  Buckets are cut into blocks; each
pair of blocks is one unit of work, and a pair of texts is looked at only in
the first tree that holds it.  Pairs whose signatures agree on fewer places
than chance allows at the threshold (``SLACK`` standard deviations) drop
out; the others are verified on the shingle sets themselves.  Texts with
equal content are one class, handled once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forest, grouped, in_blocks, map_arrow, materialise, sorted_groups
from .substrings import CLASS, hashed, packed, unpacked
from .words import Windows, Words, chunks, mix

WORDS = 5
THRESHOLD = 0.8
TREES = 16
MIN_DEPTH, MAX_DEPTH = 3, 8
RECALL = 0.9999
SLACK = 6.0
BLOCK = 512
VALUES = TREES * MAX_DEPTH


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:VALUES] | np.uint64(1), x[VALUES:]


def shingles(data: np.ndarray, offs: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all texts one after another, first index of each
    text with the total at the end); repeats are not removed."""
    words = Words(data, offs)
    windows = Windows(words.hashes())
    n = np.diff(words.first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(words.first[:-1] - first[:-1], count) + np.arange(first[-1])
    return windows.at(start, np.repeat(np.minimum(n, k), count)), first


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """uint16 matrix of minimum hashes; rows of texts without shingles are 0."""
    out = np.zeros((len(first) - 1, VALUES), np.uint16)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        a, b = _seeds()
        at = first[:-1][full]
        with np.errstate(over="ignore"):
            for j in range(VALUES):
                least = np.minimum.reduceat((h ^ b[j]) * a[j], at)
                out[full, j] = (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _signed_rows(docs: DataFrame, text: str) -> DataFrame:
    src = hashed(docs, text)

    def run(batches):
        for batch in batches:
            for i, j, data, offs in chunks(batch.column(3)):
                h, first = shingles(data, offs)
                sig = signatures(h, first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(i, j - i) for c in range(3)]
                    + [pa.array(np.diff(first) > 0), pa.array([r.tobytes() for r in sig], pa.binary())],
                    names=["doc_id", "h1", "h2", "some", "sig"])

    return map_arrow(src, run, "doc_id long, h1 long, h2 long, some boolean, sig binary")


def recall_at(depths, threshold: float) -> float:
    """Chance that two sets of this similarity share a prefix in some tree."""
    return 1.0 - math.prod(1.0 - threshold ** d for d in depths)


def choose_depths(pairs: dict[tuple[int, int], int], threshold: float, target: float) -> list[int]:
    """Prefix length per tree: from whole branches, shorten the tree that
    pays the fewest extra candidate pairs per gain in log miss, until the
    target recall is reached.  A target that the shortest prefixes of all
    trees miss is an error."""
    if recall_at([MIN_DEPTH] * TREES, threshold) < target:
        raise ValueError(f"{TREES} trees cannot reach a recall of {target} at a similarity of {threshold}")
    depths = [MAX_DEPTH] * TREES
    while recall_at(depths, threshold) < target:
        def price(t: int) -> tuple:
            d = depths[t]
            extra = pairs.get((t, d - 1), 0) - pairs.get((t, d), 0)
            gain = math.log(1 - threshold ** d) - math.log(1 - threshold ** (d - 1))
            return ((extra + 1) / gain, t)
        t = min((t for t in range(TREES) if depths[t] > MIN_DEPTH), key=price)
        depths[t] -= 1
    return depths


_UNIT = "g long, tree int, bi int, bj int, own int, node long, sig binary"


def _pairs(group: pa.RecordBatch, depths: list[int], floor: float):
    """Candidate pairs of one unit of work: (member, array of later members).
    A pair counts here if this is the first tree that holds it, if this pair
    of blocks is the one where the two meet, and if enough places agree."""
    n, t = group.num_rows, group.column("tree")[0].as_py()
    edges = [slice(u * MAX_DEPTH, u * MAX_DEPTH + d) for u, d in enumerate(depths)]
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(n, VALUES)
    own = group.column("own").to_numpy()
    cross = group.column("bi")[0].as_py() != group.column("bj")[0].as_py()
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        if cross:
            j = j[own[i + 1:] != own[i]]
        if len(j):
            same = sig[j] == sig[i]
            ok = same[:, edges[t]].all(axis=1) & (same.mean(axis=1) >= floor)
            for e in edges[:t]:
                ok &= ~same[:, e].all(axis=1)
            if ok.any():
                yield i, j[ok]


def _candidates(rows: DataFrame, depths: list[int], floor: float) -> DataFrame:
    """Of every unit of work keep the members with a candidate pair."""
    def run(batches):
        for group in sorted_groups(batches, "g", "tree"):
            useful = np.zeros(group.num_rows, bool)
            for i, j in _pairs(group, depths, floor):
                useful[i] = True
                useful[j] = True
            if useful.any():
                yield group.filter(pa.array(useful))

    return map_arrow(rows.select("g", "tree", "bi", "bj", "own", "node", "sig"), run, _UNIT)


def _verified(rows: DataFrame, depths: list[int], floor: float, threshold: float) -> DataFrame:
    """Exact similarity of the candidate pairs of each unit of work: per
    member the documents linked with it, and a forest of the links."""
    def run(batches):
        for group in sorted_groups(batches, "g", "tree"):
            node, size = group.column("node").to_numpy(), group.column("size").to_numpy()
            sets = []
            for _, _, data, offs in chunks(unpacked(group.column("z"))):
                h, first = shingles(data, offs)
                sets += [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:])]
            count = np.array([len(s) for s in sets])
            flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
            first = np.cumsum(count) - count
            mark = np.zeros(int(flat.max()) + 1, bool)
            links, a, b = np.zeros(len(node), np.int64), [], []
            for i, j in _pairs(group, depths, floor):
                mine = flat[first[i]:first[i] + count[i]]
                mark[mine] = True
                ends = np.cumsum(count[j])
                at = np.repeat(first[j] - (ends - count[j]), count[j]) + np.arange(ends[-1])
                shared = np.add.reduceat(mark[flat[at]].astype(np.int64), ends - count[j])
                mark[mine] = False
                j = j[shared / (count[i] + count[j] - shared) >= threshold]
                if len(j):
                    links[i] += size[j].sum()
                    links[j] += size[i]
                    a.append(np.full(len(j), i))
                    b.append(j)
            if not a:
                continue
            root = forest(len(node), np.concatenate(a), np.concatenate(b))
            keep = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(links[keep]), pa.array(node[root[keep]])],
                                             names=["node", "links", "other"])

    return map_arrow(rows, run, "node long, links long, other long")


def jaccard_links(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``doc_id, h1, h2, class_id, n_links, component_id, kept`` per row.

    Two documents are linked if the Jaccard similarity of their shingle sets
    reaches ``threshold``.  ``class_id`` is the smallest doc_id with the same
    text, ``n_links`` the number of other documents linked directly (copies
    included), ``component_id`` the smallest doc_id reachable by links and
    ``kept`` whether it is the row's own.  ``h1, h2`` are the text's hashes.

    Null, empty and blank texts have no shingles and link with nothing: they
    are their own class and component.  A row without doc_id takes no part;
    its class and component are null, and it is kept.  Rows repeated with
    doc_id and text count as one document.  Other columns are not read; an
    empty table gives no rows.
    """
    rows = materialise(_signed_rows(docs, text), "jaccard-rows")
    usable = rows.where("some and doc_id is not null")
    sizes = usable.select(*CLASS, "doc_id").distinct().groupBy(*CLASS).agg(F.count(F.lit(1)).alias("size"))
    classes = materialise(usable.groupBy(*CLASS).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
                          .join(sizes, CLASS).withColumn("node", F.monotonically_increasing_id()), "jaccard-classes")
    branch = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("sig", 2 * MAX_DEPTH * t + 1, 2 * MAX_DEPTH).alias("branch"))
                                 for t in range(TREES)])).alias("b")
    branches = classes.select("node", branch).select("node", "b.tree", "b.branch")
    stub = branches.withColumn("prefix", F.substring("branch", 1, 2 * MIN_DEPTH))
    forked = stub.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tree", "prefix")
    alive = materialise(stub.join(forked, ["tree", "prefix"]).select("node", "tree", "branch"), "jaccard-branches")
    at_depth = alive.select("tree", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.substring("branch", 1, 2 * d).alias("p"))
                                                         for d in range(MIN_DEPTH, MAX_DEPTH + 1)])).alias("x"))
    # one number per tree and depth
    pairs = {(r.tree, r.d): int(r.pairs) for r in
             at_depth.groupBy("tree", F.col("x.d").alias("d"), F.col("x.p").alias("p")).agg(F.count(F.lit(1)).alias("n"))
             .groupBy("tree", "d").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pairs")).collect()}
    depths = choose_depths(pairs, threshold, recall)
    depth = F.element_at(F.array(*[F.lit(d) for d in depths]), F.col("tree") + 1)
    keyed = alive.withColumn("prefix", F.col("branch").substr(F.lit(1), 2 * depth)).drop("branch")
    buckets = keyed.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = in_blocks(keyed.join(buckets, ["tree", "prefix"]), "n", BLOCK, "node")
    units = members.select(F.xxhash64("prefix", "bi", "bj").alias("g"), "tree", "bi", "bj", "own", "node")
    floor = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / VALUES)
    wanted = materialise(_candidates(grouped(units.join(classes.select("node", "sig"), "node"), "g", "tree"), depths, floor),
                         "jaccard-candidates")
    nodes = wanted.select("node").distinct().join(classes.select("node", "size", "rep", *CLASS), "node")
    texts = packed(docs, text).join(nodes, CLASS).where("doc_id = rep").dropDuplicates(["node"]).select("node", "size", "z")
    links = materialise(_verified(grouped(wanted.join(texts, "node"), "g", "tree"), depths, floor, threshold), "jaccard-links")
    component = connected_components(links.select("node", "other"), "node", "other")
    named = component.join(classes.select("node", "rep"), "node")
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    per_node = (named.join(smallest, "component").select("node", "component_id")
                .join(links.groupBy("node").agg(F.sum("links").alias("links")), "node"))
    found = (classes.select("node", *CLASS, "rep", "size").join(per_node, "node", "left")
             .select(*CLASS, "rep", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n"),
                     F.coalesce("component_id", "rep").alias("c")))
    out = rows.select("doc_id", *CLASS).join(found, CLASS, "left")
    own = F.col("doc_id").isNotNull() & F.col("rep").isNotNull()
    return out.select("doc_id", *CLASS, F.when(own, F.col("rep")).otherwise(F.col("doc_id")).alias("class_id"),
                      F.when(own, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_links"),
                      F.when(own, F.col("c")).otherwise(F.col("doc_id")).alias("component_id")
                      ).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
