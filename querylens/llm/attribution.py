"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole; the byte lengths of its tokens give
their character spans, and an interval join places every token in one of the
document's sections.  A token that crosses a boundary is allocated by an
explicit rule, so the counts of the sections and of the characters outside
them add up to the tokens of the whole text.

Rules for a token that touches several sections:

* ``"overlap"`` - the section that holds most of its characters, the earlier
  one in a tie;
* ``"start"`` - the section of the first of its characters that lies in any.

A token that touches none is counted under section -1.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_runs, tokenizer
from .common import as_text, map_arrow

RULES = ("overlap", "start")
_LINE_FEED = re.compile("\n")
CHUNK_CHARS = 1 << 19


def token_spans(bpe, data: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the tokens of one text, given its UTF-8 bytes: all
    characters of which a token holds a byte."""
    ends = np.cumsum(bpe.token_length[ids])
    starts = ends - bpe.token_length[ids]
    number = np.cumsum((data & 0xC0) != 0x80) - 1        # character of each byte
    return number[starts], number[ends - 1] + 1


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines with their line feeds; no line for the empty text."""
    ends = [m.end() for m in _LINE_FEED.finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    ends = np.array(ends, np.int64)
    return np.concatenate([np.zeros(min(1, len(ends)), np.int64), ends[:-1]]), ends


def disjoint(spans: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Given sections in order, cut to the text; where two overlap, the
    characters belong to the earlier one."""
    start, end, top = [], [], 0
    for a, b in spans:
        a = min(max(a, top), size)
        b = min(max(b, a), size)
        top = max(top, b)
        start.append(a)
        end.append(b)
    return np.array(start, np.int64), np.array(end, np.int64)


def allocate(ts: np.ndarray, te: np.ndarray, ss: np.ndarray, se: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: none) and whether the token touches more
    than that section.  Tokens [ts, te); sections [ss, se) in order, disjoint."""
    some = np.flatnonzero(se > ss)
    s0, s1 = ss[some], se[some]
    first = np.searchsorted(s1, ts, "right")
    last = np.searchsorted(s0, te, "left") - 1
    none = first > last
    place = np.where(none, 0, first)
    inside = ~none
    if len(some):
        inside &= (s0[place] <= ts) & (s1[place] >= te)
    if rule == "overlap":
        for t in np.flatnonzero(last > first):
            k = np.arange(first[t], last[t] + 1)
            place[t] = k[np.argmax(np.minimum(s1[k], te[t]) - np.maximum(s0[k], ts[t]))]
    section = np.full(len(ts), -1, np.int64)
    section[~none] = some[place[~none]]
    return section, ~none & ~inside


_OUT = "doc_id long, section int, name string, start long, end long, n_tokens long, n_crossing long"


def token_counts(docs: DataFrame, path: str, text: str = "text", sections: str | None = None, rule: str = "overlap") -> DataFrame:
    """``doc_id, section, name, start, end, n_tokens, n_crossing`` per section
    of every row: its number, name and characters (end exclusive), the
    tokens allocated to it and those of them that also touch characters
    outside.

    ``sections`` names a column of type array<struct<name, start, end>>;
    without it the sections are the lines of the text, each with its line
    feed, and have no names.  Sections are taken in order of (start, end), cut to
    the text, and where two overlap the earlier one holds the characters;
    null sections and sections without start or end are left out.  Section
    -1 has a row only if tokens touch no section.

    Null texts count as empty; a text without sections and tokens has no
    row.  Repeated rows give repeated results, a null doc_id is carried
    along, other columns are not read, and an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text(text).alias("_t"))
    if sections:
        given = F.array_sort(F.transform(
            F.filter(F.coalesce(F.col(sections), F.array().cast("array<struct<name:string,start:int,end:int>>")),
                     lambda s: s["start"].isNotNull() & s["end"].isNotNull()),
            lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), s["name"].cast("string").alias("name"))))
        src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text(text).alias("_t"), given.alias("_s"))

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            spans = batch.column("_s") if sections else None
            doc_id = batch.column("doc_id")
            for at, texts in text_runs(batch.column("_t"), CHUNK_CHARS):
                ids, count = bpe.encode_texts(texts)
                cut = np.concatenate([[0], np.cumsum(count)])
                rows, cols = [], [[] for _ in range(6)]
                for i, t in enumerate(texts):
                    mine = ids[cut[i]:cut[i + 1]]
                    if sections:
                        given = spans[at + i].as_py()
                        ss, se = disjoint([(s["start"], s["end"]) for s in given], len(t))
                        names = [s["name"] for s in given]
                    else:
                        ss, se = line_spans(t)
                        names = [None] * len(ss)
                    if len(mine):
                        ts, te = token_spans(bpe, np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8), mine)
                        section, crossing = allocate(ts, te, ss, se, rule)
                    else:
                        section, crossing = np.zeros(0, np.int64), np.zeros(0, bool)
                    n = np.bincount(section + 1, minlength=len(ss) + 1)
                    x = np.bincount(section + 1, weights=crossing, minlength=len(ss) + 1).astype(np.int64)
                    lo = 0 if n[0] else 1
                    rows += [at + i] * (len(ss) + 1 - lo)
                    for c, v in zip(cols, (range(lo - 1, len(ss)), [None, *names][lo:], [None, *ss.tolist()][lo:],
                                           [None, *se.tolist()][lo:], n[lo:].tolist(), x[lo:].tolist())):
                        c.extend(v)
                types = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [doc_id.take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, types)]],
                    names=["doc_id", "section", "name", "start", "end", "n_tokens", "n_crossing"])

    return map_arrow(src, run, _OUT)
