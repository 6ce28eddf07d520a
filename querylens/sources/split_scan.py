"""Records of quoted CSV files and objects of JSON-array files, read by all splits
of a file in parallel (IO1, IO2).

A split cannot know whether it starts inside quotes or how deep in brackets.
One pass sums up each split for both cases: how many quotes it holds, how the
depth changes, how many records end.  These summaries compose: prefix sums
over a file's splits (one row per split) give every split its true start, and
a second pass cuts the records.  A record inside one split is emitted where it
is; only the pieces of records that cross splits meet in an exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

QUOTE, BACKSLASH = 0x22, 0x5C


def _pieces(spark: SparkSession, path: str, end: str) -> DataFrame:
    """``value, file, block``: the text between two ``end``s, in order within a split."""
    ship(spark)
    lines = spark.read.option("lineSep", end).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _splits(batches) -> Iterator[tuple[str, int, list]]:
    """(file, block, texts) of each run of rows of one split, a batch at a time."""
    for batch in batches:
        text = batch.column("value").to_pylist()
        key = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))
        cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield *key[a], text[a:b]


def _even_odd(text: bytes, escaped: bool) -> np.ndarray:
    """For every byte whether the number of quotes up to it is odd; with
    ``escaped`` a quote behind an odd run of backslashes is none."""
    data = np.frombuffer(text, np.uint8)
    quote = data == QUOTE
    if escaped and BACKSLASH in text:
        slash = data == BACKSLASH
        at = np.arange(len(data))
        start = np.maximum.accumulate(np.where(slash, -1, at))      # last byte that is no backslash
        run = at - start
        quote[1:] &= run[:-1] % 2 == 0
    return np.cumsum(quote) % 2 == 1


class _Csv:
    """Records end at a line feed outside quotes.  Start: inside quotes or not."""

    end, escaped = "\n", False

    def summary(self, text: bytes) -> tuple[int, int, list, list]:
        odd = _even_odd(text, False)
        ends = odd[np.frombuffer(text, np.uint8) == 0x0A]
        n, m = int((~ends).sum()), int(ends.sum())
        return int(odd[-1]) if len(odd) else 0, 0, [(0, n, 0)] if n else [], [(0, m, 0)] if m else []

    def cut(self, text: bytes, quoted: bool, depth: int) -> tuple[list[tuple[int, int, bool, bool]], bool, int]:
        """(start, end, begins here, ends here) of the records and the state behind."""
        odd = _even_odd(text, False) != quoted
        ends = np.flatnonzero((np.frombuffer(text, np.uint8) == 0x0A) & ~odd).tolist()
        out, at = [], 0
        for e in ends:
            out.append((at, e, at > 0 or not quoted, True))
            at = e + 1
        if at < len(text):
            out.append((at, len(text), at > 0 or not quoted, False))
        return out, bool(odd[-1]) if len(odd) else quoted, 0


class _Json:
    """Objects that are elements of the outermost array.  Start: inside a text
    or not, and the depth of open brackets."""

    end, escaped = "}", True

    def _depth(self, text: bytes, quoted: bool) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(text, np.uint8)
        outside = _even_odd(text, True) == quoted
        step = np.zeros(len(data), np.int64)
        for c, d in zip(b"{[}]", (1, 1, -1, -1)):
            step[(data == c) & outside] = d
        return np.cumsum(step), (data == 0x7D) & outside

    def summary(self, text: bytes) -> tuple[int, int, list, list]:
        out = []
        for quoted in (False, True):
            depth, close = self._depth(text, quoted)
            level, n = np.unique(depth[close], return_counts=True)
            out.append(([(int(a), int(b), 0) for a, b in zip(level, n)], int(depth[-1]) if len(depth) else 0))
        (even, a), (odd, b) = out
        quotes = _even_odd(text, True)
        return (int(quotes[-1]) if len(quotes) else 0), 0, [*even, (0, 0, a)], [*odd, (0, 0, b)]

    def cut(self, text: bytes, quoted: bool, depth: int) -> tuple[list[tuple[int, int, bool, bool]], bool, int]:
        level, close = self._depth(text, quoted)
        level = level + depth
        data = np.frombuffer(text, np.uint8)
        before = np.concatenate([[depth], level[:-1]])
        opens = np.flatnonzero((data == 0x7B) & (before == 1) & (level == 2)).tolist()
        ends = (np.flatnonzero(close & (level == 1)) + 1).tolist()
        out = []
        if depth > 1:                      # inside an object
            first = ends.pop(0) if ends else len(text)
            out.append((0, first, False, bool(len(text)) and first <= len(text) and bool(close[first - 1]) and level[first - 1] == 1))
        for i, a in enumerate(opens):
            out.append((a, ends[i], True, True) if i < len(ends) else (a, len(text), True, False))
        odd = _even_odd(text, True)
        return out, (bool(odd[-1]) != quoted if len(odd) else quoted), int(level[-1]) if len(level) else depth


_SUMMARY = "file string, block long, part int, flip int, even array<struct<level:long,n:long,delta:long>>, odd array<struct<level:long,n:long,delta:long>>"
_RECORDS = "file string, number long, block long, part int, text string, whole boolean"


def _joined(texts: list, end: str) -> bytes:
    return b"".join(t.encode() + end.encode() for t in texts)


def _scan(spark: SparkSession, path: str, kind) -> DataFrame:
    """``file, number, text``: every record with its position in its file."""
    pieces = _pieces(spark, path, kind.end)
    end = kind.end
    numbers = pa.struct([("level", pa.int64()), ("n", pa.int64()), ("delta", pa.int64())])

    def summaries(batches):
        part: dict = {}
        for file, block, texts in _splits(batches):
            i = part[file, block] = part.get((file, block), -1) + 1
            flip, _, even, odd = kind.summary(_joined(texts, end))
            yield pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([block], pa.int64()), pa.array([i], pa.int32()), pa.array([flip], pa.int32()),
                 *(pa.array([[dict(zip(("level", "n", "delta"), x)) for x in some]], pa.list_(numbers)) for some in (even, odd))],
                names=["file", "block", "part", "flip", "even", "odd"])

    # a split's batches in order, then one row per split: true start states by prefix sums
    parts = pieces.mapInArrow(summaries, _SUMMARY)
    order = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0))
    known = parts.withColumn("quoted", before("flip") % 2)
    known = known.withColumn("seen", F.when(F.col("quoted") == 1, F.col("odd")).otherwise(F.col("even")))
    known = known.withColumn("change", F.aggregate("seen", F.lit(0).cast("long"), lambda a, x: a + x["delta"]))
    known = known.withColumn("depth", before("change"))
    at = F.lit(1) if isinstance(kind, _Json) else F.lit(0)
    known = known.withColumn("count", F.aggregate("seen", F.lit(0).cast("long"), lambda a, x: a + F.when(x["level"] + F.col("depth") == at, x["n"]).otherwise(0)))
    start = known.withColumn("number", before("count")).where("part = 0").select("file", "block", "quoted", "depth", "number")

    def records(batches):
        state: dict = {}
        for batch in batches:
            first = {(f, b): (q, d, n) for f, b, q, d, n in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "quoted", "depth", "number")))}
            for file, block, texts in _splits([batch]):
                quoted, depth, number, i = state.get((file, block)) or (bool(first[file, block][0]), first[file, block][1], first[file, block][2], 0)
                text = _joined(texts, end)
                found, quoted, depth = kind.cut(text, quoted, depth)
                rows = []
                for a, b, begins, ends in found:
                    rows.append((number, text[a:b].decode("utf-8", "replace"), begins and ends))
                    number += ends
                state = {(file, block): (quoted, depth, number, i + 1)}
                if rows:
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * n), pa.array([r[0] for r in rows], pa.int64()), pa.array([block] * n, pa.int64()), pa.array([i] * n, pa.int32()),
                         pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows])], names=["file", "number", "block", "part", "text", "whole"])

    # one row per split, and the splits stay where they are
    placed = pieces.join(F.broadcast(start), ["file", "block"]).select("value", "file", "block", "quoted", "depth", "number")
    cut = placed.mapInArrow(records, _RECORDS)
    crossing = (cut.where(~F.col("whole")).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("p"))
                .select("file", "number", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text")))
    return cut.where("whole").select("file", "number", "text").unionByName(crossing)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, number, text``: records of CSV files with doubled quotes, from 0
    (the header, if any, is record 0 of its file)."""
    found = _scan(spark, path, _Csv())
    return found.select("file", "number", F.regexp_replace("text", r"\r?\n?\z", "").alias("text"))


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """``file, number, text``: objects of JSON-array files, from 0."""
    return _scan(spark, path, _Json())


def parsed_csv(records: DataFrame, ddl: str, options: dict[str, str], column: str = "text") -> DataFrame:
    row: Column = F.from_csv(F.col(column), ddl, options)
    return records.select(row.alias("r")).select("r.*")
