"""Spelling variants: pairs of vocabulary words one edit apart, by
finite-state composition.

The vocabulary is partitioned by initial states of its acceptor.  Two words
that differ by one inserted, deleted or replaced code point, the longer one
of ``m`` code points, either agree on the first ``m // 2`` code points and
differ behind them, or differ earlier and then agree on the last ``m - m //
2``.  So a word goes to the state its first half leads to, and, read
backwards, to the one its last half leads to, for ``m`` its own length and
that length plus one.  In every partition the words of ``m`` and of ``m - 1``
code points become two minimised acceptors, which are composed with the
one-edit transducer and each other; the accepted pairs are enumerated.

A partition of more than ``PARTITION`` words is not loaded: its words move
on by one code point, and the pairs with their edit at that code point,
which agree on all others, are partitions of their own (of one word per
letter of the alphabet).  Nothing is capped.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, map_arrow, materialise, shuffle_partitions

PARTITION = 20_000
MIN_LENGTH, MIN_COUNT = 7, 2
FORM_RATIO = 10
DELETE_EVERY = 31


# ---- acceptors -------------------------------------------------------------

class Acceptor:
    """Minimised acyclic acceptor of sorted distinct words.  State ``s`` has
    the transitions ``arcs[s]`` (character -> state) and accepts if
    ``final[s]``; state 0 is final without transitions; ``start`` is the
    initial state."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[bool] = [True]
        known = {(True, ()): 0}
        path: list[tuple[dict[str, int], bool]] = [({}, False)]     # unfinished states of the last word

        def close(depth: int, last: str) -> None:
            """Register the states of ``last`` below ``depth``."""
            for i in range(len(last), depth, -1):
                arcs, final = path.pop()
                key = (final, tuple(arcs.items()))
                state = known.get(key)
                if state is None:
                    state = known[key] = len(self.arcs)
                    self.arcs.append(arcs)
                    self.final.append(final)
                path[-1][0][last[i - 1]] = state

        last = ""
        for word in words:
            depth = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                depth += 1
            close(depth, last)
            for _ in range(depth, len(word)):
                path.append(({}, False))
            path[-1] = (path[-1][0], True)
            last = word
        close(0, last)
        arcs, final = path[0]
        self.start = len(self.arcs)
        self.arcs.append(arcs)
        self.final.append(final)


class Composition:
    """Acceptor ∘ one-edit transducer ∘ acceptor, enumerated lazily.  The
    edited part is a state pair from which both acceptors must read the same
    rest; rests are found once per state pair."""

    def __init__(self, left: Acceptor, right: Acceptor):
        self.left, self.right = left, right
        self.rests: dict[tuple[int, int], list[str]] = {}

    def common(self, p: int, q: int) -> list[str]:
        """All strings accepted from both states."""
        found = self.rests.get((p, q))
        if found is None:
            found = self.rests[p, q] = []
            todo = [(p, q, "")]
            while todo:
                p, q, rest = todo.pop()
                if self.left.final[p] and self.right.final[q]:
                    found.append(rest)
                a, b = self.left.arcs[p], self.right.arcs[q]
                for c in (a if len(a) <= len(b) else b):
                    if c in a and c in b:
                        todo.append((a[c], b[c], rest + c))
        return found

    def pairs(self, edit: str) -> Iterator[tuple[str, str]]:
        """Pairs of a left and a right word: ``"replace"`` one code point (each
        pair once, the left and the right acceptor being the same) or
        ``"delete"`` one code point of the left word (at the last of equal
        code points, so that each pair comes once)."""
        todo = [("", self.left.start, self.right.start)]
        while todo:
            prefix, p, q = todo.pop()
            a, b = self.left.arcs[p], self.right.arcs[q]
            if edit == "replace":
                letters = sorted(a)
                for i, c in enumerate(letters):
                    for d in letters[i + 1:]:
                        for rest in self.common(a[c], b[d]):
                            yield prefix + c + rest, prefix + d + rest
            else:
                for c, s in a.items():
                    for rest in self.common(s, q):
                        if not rest.startswith(c):
                            yield prefix + c + rest, prefix + rest
            for c, s in a.items():
                if c in b:
                    todo.append((prefix + c, s, b[c]))


def near_pairs(long: list[str], short: list[str]) -> Iterator[tuple[str, str]]:
    """All pairs one edit apart with at least one word of ``long`` (distinct
    words of one length) and the other of ``long`` or of ``short`` (distinct
    words shorter by one).  What all words begin and end with is set aside."""
    every = [*long, *short]
    head = os.path.commonprefix(every)
    h = len(head)
    tail = os.path.commonprefix([w[:h - 1:-1] if h else w[::-1] for w in every])[::-1]
    inner = lambda words: sorted(w[h:len(w) - len(tail)] for w in words)
    a = Acceptor(inner(long))
    found = [Composition(a, a).pairs("replace")]
    if short:
        found.append(Composition(a, Acceptor(inner(short))).pairs("delete"))
    for x, y in itertools.chain(*found):
        yield head + x + tail, head + y + tail


# ---- words -----------------------------------------------------------------

def vocabulary(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
               delete_every: int = DELETE_EVERY) -> DataFrame:
    """``word, n``: maximal runs of Latin letters (A-Z lower-cased) of whole
    texts, one code point deleted where the CRC-32 of ``<doc_id>:<run>`` is a
    multiple of ``delete_every`` (the one at that number modulo the length),
    with at least ``min_length`` code points and ``min_count`` occurrences.

    Null texts have no words; a null doc_id reads as the empty text; repeated
    rows count again."""
    # shorter runs cannot reach min_length: a deletion only shortens
    runs = F.regexp_extract_all(as_text(text), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{min_length},}}"), F.lit(0))
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    one = docs.select(as_text(F.col("doc_id")).alias("i"), F.explode(runs).alias("run")).select("i", lower.alias("run"))
    h = F.crc32(F.concat_ws(":", "i", "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run").cast("long")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % delete_every == 0, cut).otherwise(F.col("run"))
    words = one.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


# ---- partitions ------------------------------------------------------------

def _partitions(words: DataFrame) -> DataFrame:
    """``side, m, state, depth, word, n``: every word with the four initial
    states it starts from; ``word`` is reversed on side 1."""
    length = F.length("word")
    sizes = F.explode(F.array(length, length + 1))
    both = words.select("word", "n", sizes.alias("m"))
    half = F.floor(F.col("m") / 2).cast("int")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("w"), half.alias("depth")),
                              F.struct(F.lit(1).alias("side"), F.reverse("word").alias("w"), (F.col("m") - half).alias("depth"))))
    rows = both.select("m", "n", sides.alias("s")).select("s.side", "m", "s.depth", F.col("s.w").alias("word"), "n")
    return rows.withColumn("state", F.substring("word", F.lit(1), F.col("depth")))


def _key() -> Column:
    return F.xxhash64("side", "m", "depth", "state")


def _split(rows: DataFrame, limit: int) -> DataFrame:
    """Partitions of at most ``limit`` words.  Those with more move on: the
    words that share the next code point form a partition, and so do those
    that agree on all code points but that one (``depth`` -1, the edit's place
    in the state)."""
    done, now = [], rows
    while True:
        # the keys of large partitions: at most (all rows / limit) of them
        hot = materialise(now.groupBy("side", "m", "depth", "state").agg(F.count(F.lit(1)).alias("k"))
                          .where(F.col("k") > limit).drop("k"), "spelling-hot")
        if hot.isEmpty():
            break
        key = ["side", "m", "depth", "state"]
        done.append(now.join(hot, key, "left_anti"))
        large = now.join(hot, key, "left_semi")
        ahead = F.substring("word", F.lit(1), F.col("depth") + 1)
        rest = F.substring("word", F.col("depth") + 2, F.length("word"))
        place = F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("state"))
        # a longer word without its next code point; a shorter one as it is
        own = F.when(F.length("word") == F.col("m"), rest).otherwise(F.substring("word", F.col("depth") + 1, F.length("word")))
        done.append(large.select("side", "m", F.lit(-1).alias("depth"), "word", "n", F.concat(place, F.lit("*"), own).alias("state")))
        now = materialise(large.where((F.length("word") > F.col("depth"))).select(
            "side", "m", (F.col("depth") + 1).alias("depth"), "word", "n", ahead.alias("state")), "spelling-large")
    for d in done:
        now = now.unionByName(d)
    return now


def _one_place(words: list[str], m: int, place: int) -> Iterator[tuple[str, str]]:
    """Pairs of words that agree on all code points but the one at ``place``."""
    long, short = sorted(w for w in words if len(w) == m), [w for w in words if len(w) < m]
    for i, a in enumerate(long):
        for b in long[i + 1:]:
            yield a, b
        for b in short:      # the deleted one must be the last of equal code points
            if a[place + 1:place + 2] != a[place]:
                yield a, b


def _links(words: DataFrame, limit: int) -> DataFrame:
    """``word, near, near_n``: both directions of every pair one edit apart."""
    rows = _split(_partitions(words), limit)
    n = shuffle_partitions(words.sparkSession)
    dealt = rows.withColumn("k", _key()).repartition(n, "k").sortWithinPartitions("k", "side", "m", "depth", "state")

    def partitions(batches):
        """(key, words, counts) of each partition, across batch borders."""
        key, words, counts = None, [], []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("side", "m", "depth", "state")]
            for k, w, c in zip(zip(*cols), batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                if k != key:
                    if len(words) > 1:
                        yield key, words, counts
                    key, words, counts = k, [], []
                words.append(w)
                counts.append(c)
        if len(words) > 1:
            yield key, words, counts

    def run(batches):
        out: tuple[list, list, list] = ([], [], [])
        for (side, m, depth, state), words, counts in partitions(batches):
            if depth < 0:
                place = int(state.split(":", 1)[0])
                found = _one_place(words, m, place)
            else:
                place = depth
                long = [w[depth:] for w in words if len(w) == m]
                if not long:
                    continue
                found = ((state + a, state + b) for a, b in near_pairs(long, [w[depth:] for w in words if len(w) < m]))
            n_of = dict(zip(words, counts))
            half = m // 2
            for a, b in found:
                na, nb = n_of[a], n_of[b]
                if side:
                    a, b = a[::-1], b[::-1]
                    if a[:half] == b[:half]:      # found on the other side
                        continue
                out[0].extend((a, b))
                out[1].extend((b, a))
                out[2].extend((nb, na))
                if len(out[0]) > 50_000:
                    yield _links_batch(out)
                    out = ([], [], [])
        if out[0]:
            yield _links_batch(out)

    return map_arrow(dealt.select("side", "m", "depth", "state", "word", "n"), run, "word string, near string, near_n long")


def _links_batch(out) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(np.array(out[2], np.int64))],
                                      names=["word", "near", "near_n"])


def group_variants(words: DataFrame, ratio: int = FORM_RATIO, limit: int = PARTITION) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a vocabulary ``word, n`` of
    distinct words.

    ``n_near`` counts the words one edit away; ``form`` is the one of largest
    n (ties: smallest in code-point order) if that ``form_n`` is at least
    ``ratio`` times the word's n, else null; ``root`` follows forms to the
    last one, the word itself if it has none.  Words of any length (at least
    two code points) and number are compared; no words give no rows.
    """
    words = materialise(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w")))
    near = _links(words, limit).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("b"))
    good = -F.col("b.n") >= ratio * F.col("n")
    found = materialise(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("b.w")).alias("form"),
        F.when(good, -F.col("b.n")).alias("form_n")), "spelling-near")
    # pointer doubling: n grows by the ratio at each step, so chains are short
    root = materialise(found.where("form is not null").select("word", F.col("form").alias("root")), "spelling-root")
    while True:
        ahead = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = root.join(ahead, "root", "left")
        if moved.where("next is not null").isEmpty():
            break
        root = materialise(moved.select("word", F.coalesce("next", "root").alias("root")), "spelling-root")
    return found.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, text: str = "text") -> DataFrame:
    """:func:`group_variants` of the :func:`vocabulary` of whole texts."""
    return group_variants(vocabulary(docs, text))
