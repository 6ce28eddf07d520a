"""Substring deduplication by level-wise doubling.

Windows of half the length are matched first; only windows repeated at that
length alone are extended to twice the length, and so on until no candidates
survive.

One level, from length ``half`` to ``window = 2 * half``:

1. A window of the longer length holds ``window - half + 1`` shorter ones and
   is represented by the one with the smallest hash (a minimizer), so about
   2 / (half + 2) of the shorter windows are looked at, and equal longer
   windows always share theirs.  Shorter windows found in one text only end
   here.
2. Neighbouring longer windows with the same minimizer form a run.  Equal
   runs are settled by one hash: all but those of the smallest doc_id are
   repeats as a whole.  Where runs with one minimizer differ and lie in
   several documents, one run of each kind is opened and its windows are
   matched by (minimizer, window hash).

All matching is by aggregates and equi-joins on hashes, so a passage shared
by a third of all documents costs one partial aggregate per task and a join
that Spark can split.  Texts with equal content form a class and are handled
once.  Words are ``[^\\x20\\x09-\\x0D]+``; texts travel between stages
zstd-compressed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, map_arrow, materialise
from .words import Windows, Words, chunks, signed, sliding_min, window_starts

CLASS = ["h1", "h2"]
SURVIVORS = 8000       # classes and compressed bytes per file and task at the levels above the first
SURVIVOR_BYTES = 32 << 20


def hashed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, h1, h2, t``: every row with its class key, two 64-bit hashes
    of the whole text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text(text).alias("t")).select(
        "doc_id", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"), "t")


def packed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, h1, h2, z``: the class key and the compressed text."""
    src = hashed(docs, text)

    def run(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            z = [len(b).to_bytes(8, "little") + codec.compress(b, asbytes=True) for b in
                 (t.as_buffer().to_pybytes() for t in batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(z, pa.binary())], names=["doc_id", "h1", "h2", "z"])

    return map_arrow(src, run, "doc_id long, h1 long, h2 long, z binary")


def unpacked(z: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd")
    raw = [codec.decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True) for b in z.to_pylist()]
    return pa.array(raw, pa.large_binary()).cast(pa.large_string())


class _Level:
    """Candidate windows of a run of texts: ``start`` (word index), ``text``
    (text number), ``key`` (minimizer)."""

    def __init__(self, data, offs, window: int, inside=None):
        half = (window + 1) // 2
        words = Words(data, offs)
        self.words, self.windows = words, Windows(words.hashes())
        start = window_starts(words.first, window)
        key = sliding_min(self.windows.all(half), window - half + 1)[start]
        text = np.searchsorted(words.first, start, "right") - 1
        if inside is not None:
            ok = inside(start, text, words.first)
            start, key, text = start[ok], key[ok], text[ok]
        self.start, self.key, self.text = start, key, text


def _covers(spans: list, n_words: int, window: int, field: str) -> np.ndarray:
    """Words covered by the windows of a text's spans; ``field`` names the
    offsets that count, null meaning all windows."""
    edge = np.zeros(n_words + 1, np.int32)
    for s in spans or ():
        if s[field] is None:
            starts = np.arange(s["start"], s["start"] + s["windows"])
        else:
            starts = s["start"] + np.asarray(s[field], np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _inside(spans: list, window: int):
    """Filter for candidates of the next level: windows of ``window`` words
    that lie in words covered at the level below."""
    def ok(start, text, first):
        total = int(first[-1])
        bare = np.zeros(total + 1, np.int64)
        for i, s in enumerate(spans):
            a, b = int(first[i]), int(first[i + 1])
            bare[a + 1:b + 1] = ~_covers(s, b - a, window // 2, "shared")
        bare = np.cumsum(bare)
        return bare[start + window] == bare[start]
    return ok


def _minimizers(rows: DataFrame, window: int) -> DataFrame:
    """``h1, h2, doc_id, keys``: distinct minimizers of a text's candidates."""
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            texts = unpacked(batch.column("z")) if "z" in names else batch.column("t")
            spans = batch.column("spans").to_pylist() if "spans" in names else None
            for i, j, data, offs in chunks(texts):
                level = _Level(data, offs, window, _inside(spans[i:j], window) if spans else None)
                order = np.lexsort((level.key, level.text))
                key, text = level.key[order], level.text[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
                key, text = key[new], text[new]
                ends = np.searchsorted(text, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(i, j - i) for c in ("h1", "h2", "doc_id")]
                    + [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(signed(key)))],
                    names=["h1", "h2", "doc_id", "keys"])

    return map_arrow(rows, run, "h1 long, h2 long, doc_id long, keys array<long>")


_RUN = "h1 long, h2 long, doc_id long, m long, k long, start int, windows int, hashes array<long>"


def _runs(rows: DataFrame, window: int) -> DataFrame:
    """Runs of candidates whose minimizer is among the text's ``keys``."""
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            spans = batch.column("spans").to_pylist() if "spans" in names else None
            keys = batch.column("keys")
            for i, j, data, offs in chunks(unpacked(batch.column("z"))):
                level = _Level(data, offs, window, _inside(spans[i:j], window) if spans else None)
                cut = np.searchsorted(level.text, np.arange(j - i + 1))
                hit = np.zeros(len(level.start), bool)
                for t in range(j - i):
                    mine = keys[i + t].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    hit[cut[t]:cut[t + 1]] = np.isin(level.key[cut[t]:cut[t + 1]], mine)
                start, key, text = level.start[hit], level.key[hit], level.text[hit]
                if not len(start):
                    continue
                new = np.ones(len(start), bool)
                new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)
                at = np.flatnonzero(new)
                count = np.diff(np.append(at, len(start)))
                whole = level.windows.at(start[at], count + window - 1)
                row = pa.array(i + text[at])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(row) for c in ("h1", "h2", "doc_id")]
                    + [pa.array(signed(key[at])), pa.array(signed(whole)),
                       pa.array((start[at] - level.words.first[text[at]]).astype(np.int32)),
                       pa.array(count.astype(np.int32)),
                       pa.ListArray.from_arrays(pa.array(np.append(at, len(start)).astype(np.int32)),
                                                pa.array(signed(level.windows.at(start, window))))],
                    names=["h1", "h2", "doc_id", "m", "k", "start", "windows", "hashes"])

    return map_arrow(rows, run, _RUN)


def extend(texts: DataFrame, keyed: DataFrame, window: int, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One level.  ``keyed``: ``h1, h2, doc_id, keys``, one row per class with
    its smallest doc_id.  ``texts``: ``doc_id, h1, h2, z`` (and ``spans`` of
    the level below).  Returns the texts of the classes with candidates, and
    ``h1, h2, spans``: runs of windows of ``window`` words of each class, and in
    each run the offsets of windows that also start in a class with a smaller
    doc_id (``repeats``) or with any other (``shared``), null meaning all.
    ``parts``: see :func:`materialise`."""
    anchors = keyed.select("h1", "h2", "doc_id", F.explode("keys").alias("m"))
    shared = (anchors.groupBy("m").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
              .where("a < b").select("m"))
    alive = (anchors.join(shared, "m").groupBy("h1", "h2", F.col("doc_id").alias("rep"))
             .agg(F.collect_list("m").alias("keys")))
    some = texts.join(alive, CLASS).where("doc_id = rep").drop("rep").withColumn("size", F.octet_length("z"))
    if parts is None:      # the next level reads these instead of all texts
        some = materialise(some, "repeat-texts")
    runs = materialise(_runs(some, window), "repeat-runs", parts)
    slim = runs.select("h1", "h2", "doc_id", "m", "k", "start", "windows")
    kinds = runs.groupBy("m", "k").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    settled = slim.join(kinds, ["m", "k"])
    several = kinds.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("a"), F.max("most").alias("b"))
    # runs of one minimizer of several kinds, not all in one document
    open_kinds = kinds.join(several.where("n > 1 and a < b").select("m"), "m")
    opened = materialise(runs.join(open_kinds, ["m", "k"]).where("doc_id = least").dropDuplicates(["m", "k"])
                         .select("m", "k", "doc_id", "most", F.posexplode("hashes").alias("off", "h")), "repeat-windows", parts)
    # a kind holds its windows in all of its documents
    least = (opened.groupBy("m", "h").agg(F.min("doc_id").alias("a"), F.max("most").alias("b"))
             .where("a < b").select("m", "h", "a"))
    if parts is None:      # written, so that the join has exchanges of its own, which Spark can split
        least = materialise(least, "repeat-least")
    # windows of a kind in several documents are all shared: only repeats are listed
    hits = (opened.join(least, ["m", "h"]).where("doc_id > a or doc_id = most").groupBy("m", "k")
            .agg(F.collect_list("off").alias("any"), F.collect_list(F.when(F.col("doc_id") > F.col("a"), F.col("off"))).alias("later")))
    none, everything = F.array().cast("array<int>"), F.lit(None).cast("array<int>")
    whole = settled.where("doc_id > least").select(*CLASS, "start", "windows", everything.alias("repeats"), everything.alias("shared"))
    first = settled.where("doc_id = least").join(hits, ["m", "k"], "left").select(
        *CLASS, "start", "windows", F.coalesce("later", none).alias("repeats"),
        F.when(F.col("most") == F.col("least"), F.coalesce("any", none)).alias("shared"))
    spans = (whole.union(first.where("shared is null or size(shared) > 0"))
             .groupBy(*CLASS).agg(F.collect_list(F.struct("start", "windows", "repeats", "shared")).alias("spans")))
    return some.select("doc_id", "h1", "h2", "z", "size"), materialise(spans, f"repeats-{window}", parts)


def _classes(texts: DataFrame, window: int, parts: int | None = None) -> DataFrame:
    """``h1, h2, doc_id, keys``: one row per class with a known doc_id."""
    found = _minimizers(texts, window).where("doc_id is not null")
    return materialise(found.groupBy(*CLASS).agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys")), "repeat-classes", parts)


def _removed(rows: DataFrame, window: int) -> DataFrame:
    """The kept text of every row, its words, removed word spans and the
    longest repeat."""
    def run(batches):
        for batch in batches:
            ids, rep = batch.column("doc_id").to_pylist(), batch.column("rep").to_pylist()
            spans, levels = batch.column("spans"), batch.column("longest").to_pylist()
            for i, j, data, offs in chunks(unpacked(batch.column("z"))):
                words = Words(data, offs)
                n_words, n_gone, longest, kept, gone_spans = [], [], [], [], []
                blob = data.tobytes()
                for t in range(j - i):
                    a, b = int(words.first[t]), int(words.first[t + 1])
                    own, first = ids[i + t], rep[i + t]
                    gone, reach = np.zeros(b - a, bool), 0
                    if own is not None and first is not None:
                        if own > first and b - a >= window:      # a copy repeats as a whole
                            gone[:] = True
                            reach = window << ((b - a) // window).bit_length() - 1
                        elif own == first and spans[i + t].is_valid:
                            gone, reach = _covers(spans[i + t].as_py(), b - a, window, "repeats"), levels[i + t] or 0
                    stay = a + np.flatnonzero(~gone)
                    if len(stay) == b - a:   # only the separators change
                        kept.append(b" ".join(blob[offs[t]:offs[t + 1]].split()))
                    else:
                        kept.append(b" ".join([blob[s:e] for s, e in zip(words.start[stay].tolist(), words.end[stay].tolist())]))
                    n_words.append(b - a)
                    n_gone.append(int(gone.sum()))
                    longest.append(reach)
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    gone_spans.append(edge.reshape(-1, 2).tolist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()),
                     pa.array(longest, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                     pa.array(gone_spans, pa.list_(pa.list_(pa.int32())))],
                    names=["doc_id", "n_words", "n_removed", "longest_repeat", "kept_text", "removed_spans"])

    return map_arrow(rows, run, "doc_id long, n_words long, n_removed long, longest_repeat long, kept_text string, "
                                "removed_spans array<array<int>>")


def substring_dedup(docs: DataFrame, window: int = 50, text: str = "text") -> DataFrame:
    """Remove every word covered by a window of ``window`` consecutive words
    whose word sequence also starts in a document with a smaller doc_id.

    Returns one row per input row: ``doc_id, n_words, n_removed, kept_text``
    (kept words joined by one blank), ``removed_spans`` (word ranges, end
    exclusive) and ``longest_repeat``, the largest of ``window, 2 * window,
    4 * window, ...`` at which the document holds a window that also starts in
    one with a smaller doc_id, 0 without any.  Windows are judged on the
    input, not on what is left.

    Null or empty texts have no words.  A row without doc_id keeps all its
    words and is no evidence against others.  Rows with one doc_id are one
    document to each other: repeats between them stay; a repeated row gives a
    repeated result.  Texts shorter than a window are kept.  Equal texts form
    a class of which the smallest doc_id stays.  Other columns are not read;
    an empty table gives no rows.
    """
    texts = packed(docs, text)
    classes = _classes(hashed(docs, text), window)
    some, spans = extend(texts, classes, window)
    length, level, reached = window, spans, []
    while not level.isEmpty():
        later = level.where(F.exists("spans", lambda s: s["repeats"].isNull() | (F.size(s["repeats"]) > 0)))
        reached.append(later.select(*CLASS, F.lit(length).cast("long").alias("longest")))
        # a window of twice the length needs more than `length` starts in a row
        starts = F.aggregate("spans", F.lit(0), lambda n, s: n + s["windows"])
        survivors = level.where(starts > length)
        # the texts are read with the parallelism of their files; what is left is brought together behind an exchange
        n, size = some.select(*CLASS, "size").join(survivors.select(*CLASS), CLASS).agg(F.count(F.lit(1)), F.sum("size")).first()
        parts = 1 + max(n // SURVIVORS, (size or 0) // SURVIVOR_BYTES)
        some = materialise(some.drop("size").join(survivors, CLASS).repartition(parts), "repeat-survivors")
        length *= 2
        _, level = extend(some, _classes(some, length, parts), length, parts)
        some = some.select("doc_id", "h1", "h2", "z", F.octet_length("z").alias("size"))
    found = spans.withColumn("longest", F.lit(None).cast("long"))
    if reached:
        every = reached[0]
        for r in reached[1:]:
            every = every.union(r)
        found = spans.join(every.groupBy(*CLASS).agg(F.max("longest").alias("longest")), CLASS, "left")
    reps = classes.select("h1", "h2", F.col("doc_id").alias("rep"))
    rows = texts.join(reps.join(found, CLASS, "left"), CLASS, "left")
    return _removed(rows.select("doc_id", "z", "rep", "spans", "longest"), window)
