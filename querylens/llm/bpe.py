"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word (a piece of the split pattern) is held as a row of part ids next to a
row of the merge ranks of adjacent parts.  One step scans the ranks for the
leftmost minimum, deletes the boundary there (both rows close up by one) and
refreshes the two neighbouring ranks.  Words of one byte length form a
matrix, so a step is a handful of numpy calls for thousands of words, and
every row shrinks by exactly one part per step.  Pieces over
``SHORT_BYTES`` bytes, for which repeated scans would be quadratic, use a
heap of (rank, position) over linked parts; the merges and their order are
the same.

Texts are encoded whole.  Distinct pieces are encoded once per worker and
kept in a table bounded by ``CACHE_PIECES``; the table is a cache only.
"""

from __future__ import annotations

import heapq
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, map_arrow

SHORT_BYTES = 64
CACHE_PIECES = 300_000
STREAM_CHARS = 1 << 22
CHUNK_CHARS = 1 << 20

#: Fixed value: the split pattern of the byte-level vocabulary.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NO_RANK = np.int32(np.iinfo(np.int32).max)


def printable_bytes() -> dict[str, int]:
    """Characters that stand for bytes in vocabulary files: printable Latin-1
    bytes stand for themselves, the others for code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def spread(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated slices [first, first + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(first - (ends - lengths), lengths) + np.arange(total)


class PieceTable(dict):
    """Piece -> number; new pieces are queued for encoding."""

    def __init__(self):
        self.queue: list[str] = []

    def __missing__(self, piece: str) -> int:
        i = self[piece] = len(self)
        self.queue.append(piece)
        return i


class ByteBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_byte = printable_bytes()
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *special.values()])
        table = [b""] * size
        for token, i in vocab.items():
            table[i] = bytes(as_byte[c] for c in token)
        for token, i in special.items():
            table[i] = token.encode()
        self.size, self.special = size, special
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.token_length = np.array([len(t) for t in table], np.int64)
        self.token_first = np.cumsum(self.token_length) - self.token_length
        self.byte_id = np.zeros(256, np.int32)
        for c, b in as_byte.items():
            self.byte_id[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        # a closing key no pair can have keeps the binary search in range
        self.pair_key = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_rank = np.append(order.astype(np.int32), NO_RANK)
        self.rank_id = made
        self.rank_of = {int(k): r for r, k in enumerate(keys)}
        self.split = regex.compile(SPLIT_PATTERN)
        self.special_split = (regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")
                              if special else None)
        self.forget()

    # ---- pieces -> ids -------------------------------------------------

    def forget(self) -> None:
        self.pieces = PieceTable()
        self.first = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.int32)
        self.used = 0

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.pair_key, key)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NO_RANK)

    def merge_rows(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode words of one byte length, a row of byte ids each: (ids of
        all rows one after another, ids per row)."""
        n, width = parts.shape
        out = np.zeros((n, width), np.int32)
        count = np.zeros(n, np.int64)
        row = np.arange(n)
        ranks = self.ranks(parts[:, :-1], parts[:, 1:]) if width > 1 else np.zeros((n, 0), np.int32)
        while len(row):
            width = parts.shape[1]
            if width > 1:
                at = ranks.argmin(axis=1)
                rank = ranks[np.arange(len(row)), at]
                done = rank == NO_RANK
            else:
                done = np.ones(len(row), bool)
            if done.any():
                ended = row[done]
                out[ended, :width] = parts[done]
                count[ended] = width
                go = ~done
                row, parts, ranks = row[go], parts[go], ranks[go]
                if not len(row):
                    break
                at, rank = at[go], rank[go]
            r = np.arange(len(row))
            # delete the boundary: parts and ranks close up behind it
            column = np.arange(width - 1)
            parts_at = column + (column > at[:, None])
            merged = np.take_along_axis(parts, parts_at, 1)
            merged[r, at] = self.rank_id[rank]
            if width == 2:
                parts, ranks = merged, np.zeros((len(row), 0), np.int32)
                continue
            column = column[:-1]
            ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), 1)
            has = at > 0
            i, k = r[has], at[has]
            ranks[i, k - 1] = self.ranks(merged[i, k - 1], merged[i, k])
            has = at < width - 2
            i, k = r[has], at[has]
            ranks[i, k] = self.ranks(merged[i, k], merged[i, k + 1])
            parts = merged
        keep = np.arange(out.shape[1]) < count[:, None]
        return out[keep], count

    def merge_long(self, data: bytes) -> list[int]:
        """One long piece: heap of (rank, position) over linked parts."""
        ids = self.byte_id[np.frombuffer(data, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of, size, made = self.rank_of, self.size, self.rank_id
        heap = [(rank_of[k], i) for i in range(n - 1) if (k := ids[i] * size + ids[i + 1]) in rank_of]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or rank_of.get(ids[i] * size + ids[j]) != rank:
                continue
            ids[i], ids[j] = int(made[rank]), -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of.get(ids[i] * size + ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank_of.get(ids[h] * size + ids[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in ids if x >= 0]

    def _store(self, number: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        top = int(number.max()) + 1
        if top > len(self.first):
            grown = max(top, 2 * len(self.first))
            self.first, self.length = (np.concatenate([x, np.zeros(grown - len(x), np.int64)])
                                       for x in (self.first, self.length))
        if self.used + len(ids) > len(self.flat):
            grown = max(self.used + len(ids), 2 * len(self.flat))
            self.flat = np.concatenate([self.flat, np.zeros(grown - len(self.flat), np.int32)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.first[number] = self.used + np.cumsum(count) - count
        self.length[number] = count
        self.used += len(ids)

    def _encode_queue(self) -> None:
        queue = self.pieces.queue
        if not queue:
            return
        base = len(self.pieces) - len(queue)
        raw = [p.encode("utf-8", "surrogatepass") for p in queue]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts = np.cumsum(sizes) - sizes
        for width in np.unique(sizes):
            mine = np.flatnonzero(sizes == width)
            if width <= SHORT_BYTES:
                ids, count = self.merge_rows(self.byte_id[data[starts[mine][:, None] + np.arange(width)]])
                self._store(base + mine, ids, count)
            else:
                for i in mine:
                    ids = np.array(self.merge_long(raw[i]), np.int32)
                    self._store(np.array([base + i]), ids, np.array([len(ids)]))
        self.pieces.queue = []

    def _pieces_to_ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = self.length[numbers]
        return self.flat[spread(self.first[numbers], count)], count

    def _segments(self, text: str) -> Iterator[str]:
        """Parts of a text between special tokens, and those tokens."""
        if self.special_split is not None and any(s in text for s in self.special):
            return (s for s in self.special_split.split(text) if s)
        return iter((text,))

    def _numbers(self, text: str) -> np.ndarray:
        """Piece numbers of a text; a special token is -1 - id."""
        look = self.pieces.__getitem__
        parts = []
        for segment in self._segments(text):
            if segment in self.special:
                parts.append(np.array([-1 - self.special[segment]], np.int64))
            elif len(segment) < STREAM_CHARS:
                found = self.split.findall(segment)
                parts.append(np.fromiter(map(look, found), np.int64, len(found)))
            else:
                matches = self.split.finditer(segment)
                while some := [m.group() for m in itertools.islice(matches, 200_000)]:
                    parts.append(np.fromiter(map(look, some), np.int64, len(some)))
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.int64), *parts])

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids per text)."""
        if len(self.pieces) > CACHE_PIECES:
            self.forget()
        numbers = [self._numbers(t) for t in texts]
        self._encode_queue()
        per_text = np.fromiter(map(len, numbers), np.int64, len(numbers))
        numbers = np.concatenate([np.zeros(0, np.int64), *numbers])
        special = numbers < 0
        if special.any():
            ids_of, count = self._pieces_to_ids(np.where(special, 0, numbers))
            keep = np.repeat(~special, count)
            kept = np.where(special, 1, count)
            ids = np.zeros(int(kept.sum()), np.int32)
            mask = np.repeat(special, kept)
            ids[mask] = (-1 - numbers[special]).astype(np.int32)
            ids[~mask] = ids_of[keep]
            count = kept
        else:
            ids, count = self._pieces_to_ids(numbers)
        ends = np.concatenate([[0], np.cumsum(count)])
        at = np.concatenate([[0], np.cumsum(per_text)])
        return ids, ends[at[1:]] - ends[at[:-1]]

    # ---- ids -> text ---------------------------------------------------

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.token_bytes[spread(self.token_first[ids], self.token_length[ids])]

    def decode_ids(self, ids: np.ndarray) -> str:
        return self.bytes_of(ids).tobytes().decode("utf-8", "replace")


_loaded: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    """The vocabulary at ``path``, loaded once per worker."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def text_runs(texts: pa.Array, chars: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about ``chars`` characters: (first row, texts);
    null is the empty text."""
    run, size, first = [], 0, 0
    for i, t in enumerate(texts):
        t = t.as_py() or ""
        if run and size + len(t) > chars:
            yield first, run
            run, size, first = [], 0, i
        run.append(t)
        size += len(t)
    if run:
        yield first, run


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids", decoded: str | None = None,
           carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``carry`` and ``out`` (array<int>, the token ids of the whole
    text); with ``decoded`` also the text decoded from those ids.

    Null texts count as empty and give no ids; special tokens written in a
    text give their own id; rows are independent, so repeated rows, ties and
    other columns change nothing.  An empty table gives no rows.  Memory per
    worker is bounded by the piece table, one run of texts and the longest
    text.
    """
    src = docs.select(*carry, as_text(text).alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[:-1]] + [f"`{out}` array<int>"]
    if decoded:
        fields.append(f"`{decoded}` string")

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for first, some in text_runs(texts):
                ids, count = bpe.encode_texts(some)
                offsets = np.concatenate([[0], np.cumsum(count)])
                arrays = [batch.column(i).slice(first, len(some)) for i in range(batch.num_columns - 1)]
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32())))
                names = [*batch.schema.names[:-1], out]
                if decoded:
                    arrays.append(pa.array([bpe.decode_ids(ids[a:b]) for a, b in itertools.pairwise(offsets)], pa.string()))
                    names.append(decoded)
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return map_arrow(src, run, ", ".join(fields))


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "text",
           carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``carry`` and ``out``: the text of an array<int> column.  A
    null array gives the empty text; bytes that form no character become
    U+FFFD."""
    src = rows.select(*carry, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("_ids"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[:-1]] + [f"`{out}` string"]

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            texts = [bpe.decode_ids(np.asarray(x.values, np.int64)) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())],
                                             names=[*batch.schema.names[:-1], out])

    return map_arrow(src, run, ", ".join(fields))


def round_trip_digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document ``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the
    whole text encoded and decoded again from the ids."""
    done = encode(docs, path, decoded="decoded")
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
