"""Token ids as length-delimited binary records with a separate offset index.

A table of documents becomes record files in ascending ``doc_id`` order.  A
record frames one serialized sequence:

    uint64  length of the payload
    uint32  masked CRC-32C of those eight bytes
    payload
    uint32  masked CRC-32C of the payload

all little-endian; a checksum ``c`` is stored as ``rotate_right(c, 15) +
0xa282ead8``.  The payload is ``int64 doc_id, uint32 width | known << 8,
uint32 count`` and ``count`` ids of ``width`` bytes (2 if every id of the
vocabulary fits, else 4), padded with zeros to a multiple of four bytes.

Rows are sorted by ranges of ``doc_id``; a task streams its range into one
file and returns the place of every record, so the files of failed or
speculative attempts are in nobody's index.  The index is a Parquet table of
its own (``part, file, offset, length, doc_id, n_tokens, start``), from which
records are read in file order or in any shuffled order.

Texts are encoded with the ``tokenizers`` library's byte-level BPE model.  The
split pattern never crosses from other characters into white space, so a text is a sequence of
units (white space, then the characters up to the next white space) that
encode on their own; every distinct unit passes the library once per worker
(``UNITS`` of them are kept, a cache only).
"""

from __future__ import annotations

import gc
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import SPLIT_PATTERN, printable_bytes, spread, text_runs
from .common import as_text, map_arrow, materialise, shuffle_partitions
from ..session import ensure_checkpoint_dir

UNITS = 1_000_000
UNIT_CHARS = 32 << 20
CHUNK_CHARS = 1 << 21
PIECE_CHARS = 32
READ_BYTES = 4 << 20
OPEN_FILES = 32

# ---- checksums -------------------------------------------------------------

#: Reflected polynomial of CRC-32C and the mask of stored checksums.
POLYNOMIAL = 0x82F63B78
MASK_ADD = 0xA282EAD8


def _byte_table() -> np.ndarray:
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), state >> np.uint32(1))
    return state


def _tables(columns: np.ndarray) -> np.ndarray:
    """Lookup tables, one per byte of a state, of the linear map whose images of the
    32 single bits are ``columns``."""
    out = np.zeros((4, 256), np.uint32)
    for b in range(4):
        for bit in range(8):
            out[b, (np.arange(256) >> bit) & 1 == 1] ^= columns[8 * b + bit]
    return out


def _apply(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    low = np.uint32(255)
    return (tables[0][state & low] ^ tables[1][(state >> np.uint32(8)) & low]
            ^ tables[2][(state >> np.uint32(16)) & low] ^ tables[3][state >> np.uint32(24)])


_shifts: list[np.ndarray] = []


def shift(level: int) -> np.ndarray:
    """Tables of appending ``4 << level`` zero bytes to a message."""
    if not _shifts:
        table, columns = _byte_table(), np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(4):
            columns = table[columns & np.uint32(255)] ^ (columns >> np.uint32(8))
        _shifts.append(_tables(columns))
    while len(_shifts) <= level:
        last = _shifts[-1]
        _shifts.append(_tables(_apply(last, _apply(last, np.uint32(1) << np.arange(32, dtype=np.uint32)))))
    return _shifts[level]


def crc32c(words: np.ndarray, count: np.ndarray) -> np.ndarray:
    """CRC-32C of messages of whole 32-bit words, ``count`` words each, one
    after another in ``words``.  Neighbouring blocks of all messages are
    joined level by level: a block's state is moved past its right neighbour
    by a linear map.  A message's left-most block may stand alone, as leading
    zeros do not change a state."""
    count = np.asarray(count, np.int64)
    start = np.full(len(count), 0xFFFFFFFF, np.uint32)       # the initial state moves past the whole message
    for level in range(int(count.max(initial=0)).bit_length()):
        has = (count >> level) & 1 == 1
        start[has] = _apply(shift(level), start[has])
    state, size, level = _apply(shift(0), words.astype(np.uint32)), count, 0
    while size.max(initial=0) > 1:
        half = (size + 1) // 2
        ends = np.cumsum(half)
        odd = (size & 1).astype(np.int64)
        # places of right blocks: from the end of every message in steps of two
        first = np.cumsum(size) - size
        inner = np.arange(int(ends[-1])) - np.repeat(ends - half, half)
        right = np.repeat(first - odd, half) + 2 * inner + 1
        left = right - 1
        joined = state[right]
        paired = left >= np.repeat(first, half)
        joined[paired] ^= _apply(shift(level), state[left[paired]])
        state, size, level = joined, half, level + 1
    total = np.zeros(len(count), np.uint32)
    total[count > 0] = state
    return ~(total ^ start)


def masked(crc: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_ADD)


# ---- texts -> ids ----------------------------------------------------------

#: Fixed value: the characters with the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_WHITE = frozenset(["", *re.findall(f"[{WHITE}]", "".join(map(chr, range(0x3001))))])      # and the empty text


#: Below it, Python's letters and the split pattern's are the same.
LATIN_END = "\u0250"

#: Characters that the split pattern separates from a letter in front of them.
MARKS = frozenset(".,;:!?)")


class _Numbers(dict):
    """Unit -> number; new units are queued with their leading text.  A unit
    that ends in a letter and a mark is put together from its two parts."""

    def __init__(self, encoder: "UnitEncoder", lead: str):
        self.encoder, self.lead = encoder, lead

    def __missing__(self, unit: str) -> int:
        e = self.encoder
        if self.lead and (unit[:1] in _WHITE or unit[-1:] in _WHITE):
            return -1                        # white space next to the blank: the text has other units
        parts = None
        if unit[-1:] in MARKS and unit[-2:-1].isalpha():
            parts = self[unit[:-1]], e.whole[unit[-1]]
        i = self[unit] = e.known
        e.known += 1
        e.chars += len(unit)
        if parts:
            e.joined.append((i, *parts))
        else:
            e.queue.append((i, self.lead + unit))
        return i


class UnitEncoder:
    """The library's encoder, every distinct unit once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.tokenize = self.library.model.tokenize
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.split = regex.compile(SPLIT_PATTERN).findall
        self.as_char = {b: c for c, b in printable_bytes().items()}
        self.forget()

    def forget(self) -> None:
        self.known, self.chars, self.queue, self.joined = 0, 0, [], []
        self.whole, self.spaced = _Numbers(self, ""), _Numbers(self, " ")
        self.pieces: dict[str, list[int]] = {}
        self.first, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.int32), 0

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the units of all texts one after another, units per text).
        Words between blanks are looked up once per call."""
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = words.values.dictionary_encode()
        place, ends = coded.indices.to_numpy(), words.offsets.to_numpy()
        first, last = ends[:-1], ends[1:] - 1
        inner = np.ones(len(place), bool)
        inner[first] = inner[last] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[place[inner]] = True
        own = np.full(len(used), -1, np.int64)
        some = coded.dictionary.filter(pa.array(used)).to_numpy(zero_copy_only=False).tolist()
        own[used] = np.fromiter(map(self.spaced.__getitem__, some), np.int64, len(some))
        numbers = own[place]
        odd = np.concatenate([[0], np.cumsum(inner & (numbers < 0))])
        odd = odd[ends[1:]] > odd[ends[:-1]]
        parts = []
        for text, a, b, other in zip(texts, first.tolist(), last.tolist(), odd.tolist()):
            if b > a and not other:
                head, tail = text[:text.index(" ")], text[text.rindex(" "):]
                if head[-1:] not in _WHITE and tail[1:2] not in _WHITE:
                    numbers[a], numbers[b] = self.whole[head], self.whole[tail]
                    parts.append(numbers[a:b + 1])
                    continue
            units = _UNIT.findall(text)
            parts.append(np.fromiter(map(self.whole.__getitem__, units), np.int64, len(units)))
        return np.concatenate([np.zeros(0, np.int64), *parts]), np.fromiter(map(len, parts), np.int64, len(parts))

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, ids per unit).  The pieces of a unit go
        straight to the library's model; its pipeline for whole texts also
        aligns every character, which takes most of its time.  A unit with a
        special token passes the pipeline.  Latin letters, with or without a
        blank in front, are one piece; pieces of other units are kept."""
        ids: list[int] = []
        count = np.zeros(len(units), np.int64)
        split, tokenize, as_char, pieces, before = self.split, self.tokenize, self.as_char, self.pieces, 0
        blank, every = as_char[32], "".join(units)
        special = [s for s in self.special if s in every]        # most often none
        for i, unit in enumerate(units):
            word = unit[1:] if unit[:1] == " " else unit
            if special and any(s in unit for s in special):
                ids += self.library.encode(unit, add_special_tokens=False).ids
            elif word.isalpha() and word.isascii():              # printable bytes stand for themselves
                ids += [t.id for t in tokenize(word if len(word) == len(unit) else blank + word)]
            elif word.isalpha() and max(word) < LATIN_END:
                ids += [t.id for t in tokenize(unit.encode().decode("latin-1").translate(as_char))]
            else:
                for piece in split(unit):
                    own = pieces.get(piece)
                    if own is None:
                        own = [t.id for t in tokenize(piece.encode().decode("latin-1").translate(as_char))]
                        if len(piece) <= PIECE_CHARS:
                            pieces[piece] = own
                    ids += own
            count[i] = len(ids) - before
            before = len(ids)
        return np.array(ids, np.int32), count

    def _store(self, number: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        n, m = self.known, self.used + len(ids)
        if n > len(self.first):
            self.first, self.length = (np.concatenate([x, np.zeros(2 * n - len(x), np.int64)]) for x in (self.first, self.length))
        if m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(2 * m - len(self.flat), np.int32)])
        self.first[number] = self.used + np.cumsum(count) - count
        self.length[number] = count
        self.flat[self.used:m] = ids
        self.used = m

    def _encode_queue(self) -> None:
        if self.queue:
            number, units = zip(*self.queue)
            self._store(np.array(number), *self._encode(list(units)))
        if self.joined:
            number, *parts = np.array(self.joined).T
            every = np.stack(parts, 1)
            count = self.length[every]
            self._store(number, self.flat[spread(self.first[every].reshape(-1), count.reshape(-1))], count.sum(1))
        self.queue, self.joined = [], []

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids per text)."""
        if self.known > UNITS or self.chars > UNIT_CHARS:
            self.forget()
        collects = gc.isenabled()
        gc.disable()                  # many small lists, no cycles
        try:
            every, per_text = self._numbers(texts)
            self._encode_queue()
        finally:
            if collects:
                gc.enable()
        count = self.length[every]
        ends = np.concatenate([[0], np.cumsum(count)])
        at = np.concatenate([[0], np.cumsum(per_text)])
        return self.flat[spread(self.first[every], count)], ends[at[1:]] - ends[at[:-1]]


_loaded: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = UnitEncoder(path)
    return _loaded[path]


# ---- records ---------------------------------------------------------------

HEADER = 16       # payload bytes in front of the ids
FRAME = 16        # bytes of a record beside its payload


def frame(doc_id: np.ndarray, known: np.ndarray, ids: np.ndarray, count: np.ndarray, width: int) -> tuple[bytes, np.ndarray]:
    """(bytes of the records one after another, payload bytes of each)."""
    per_word = 4 // width
    body = (count + per_word - 1) // per_word                # 32-bit words of ids
    words = 4 + body                                         # payload: header and ids
    ends = np.cumsum(words)
    payload = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
    at = ends - words
    two = doc_id.astype(np.int64).view(np.uint32).reshape(-1, 2)
    payload[at], payload[at + 1] = two[:, 0], two[:, 1]
    payload[at + 2] = np.uint32(width) | (known.astype(np.uint32) << np.uint32(8))
    payload[at + 3] = count
    units = payload.view(np.uint16 if width == 2 else np.uint32)
    units[spread((at + 4) * per_word, count)] = ids
    length = words.astype(np.uint64) * np.uint64(4)
    head = length.view(np.uint32).reshape(-1, 2)
    n = len(words)
    out = np.zeros(len(payload) + 4 * n, np.uint32)
    place = at + 4 * np.arange(n)
    out[place], out[place + 1] = head[:, 0], head[:, 1]
    out[place + 2] = masked(crc32c(head.reshape(-1), np.full(n, 2)))
    out[spread(place + 3, words)] = payload
    out[place + 3 + words] = masked(crc32c(payload, words))
    return out.astype("<u4", copy=False).tobytes(), length.astype(np.int64)


class Damaged(ValueError):
    """A record whose length or checksum does not hold."""


def unframe(data: bytes, offset: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(doc_id, whether it is known, ids of each record) of the records with
    payloads of ``length`` bytes at ``offset`` of ``data``; lengths and
    checksums are verified."""
    if (offset % 4).any() or (length % 4).any() or (len(offset) and int((offset + length + FRAME).max()) > len(data)):
        raise Damaged("record outside its file")
    words = np.frombuffer(data, "<u4", len(data) // 4)
    at, n = offset // 4, length // 4
    head = np.stack([words[at], words[at + 1]], 1)
    bad = head.reshape(-1).view(np.uint64).astype(np.int64) != length
    bad |= words[at + 2] != masked(crc32c(head.reshape(-1), np.full(len(at), 2)))
    payload = words[spread(at + 3, n)]
    bad |= words[at + 3 + n] != masked(crc32c(payload, n))
    if bad.any():
        raise Damaged(f"{int(bad.sum())} records do not match their checksums")
    first = np.cumsum(n) - n
    doc_id = np.stack([payload[first], payload[first + 1]], 1).reshape(-1).view(np.int64)
    kind, count = payload[first + 2], payload[first + 3].astype(np.int64)
    ids = []
    for a, k, c in zip(first.tolist(), (kind & np.uint32(255)).tolist(), count.tolist()):
        own = payload[a + 4:a + 4 + (c * k + 3) // 4]
        ids.append(own.view("<u2")[:c] if k == 2 else own[:c])
    return doc_id, (kind >> np.uint32(8)) == 1, ids


# ---- files -----------------------------------------------------------------

def storage(folder: str):
    """(pyarrow file system, path) of a folder of the shared storage: a local
    path or any address pyarrow opens (file, hdfs, s3, gs)."""
    from pyarrow import fs
    local = re.fullmatch(r"file:/+(.*)", folder)
    if local or "://" not in folder:
        return fs.LocalFileSystem(), "/" + local.group(1) if local else folder
    return fs.FileSystem.from_uri(folder)


_LOCAL = "part int, file string, offset long, length long, doc_id long, n_tokens long, before long"


def write_records(docs: DataFrame, path: str, folder: str, end_id: int | None = None, text: str = "text") -> DataFrame:
    """Encode the whole texts, write them as records in ascending doc_id
    order into ``folder`` (on storage that all executors share) and write the
    offset index there; returns the index.

    Index: ``part`` (number of the file in document order), ``file``,
    ``offset`` and ``length`` (payload bytes) of the record, ``doc_id``,
    ``n_tokens`` and ``start`` (tokens of all documents before it).  With
    ``end_id`` that id is appended to every document.

    Null texts count as empty: without ``end_id`` their records hold no ids.
    Rows without doc_id come last.  Rows with one doc_id are documents of
    their own next to each other, ordered by a hash of their texts; equal
    rows are interchangeable.  Texts of any length are one record (up to 4 G
    ids).  Other columns are not read; an empty table gives an index without
    rows.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text(text).alias("t"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("t")]
    dealt = src.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)

    def run(batches):
        own = encoder(path)
        width = 2 if max(own.size, (end_id or 0) + 1) <= 1 << 16 else 4
        part = TaskContext.get().partitionId()
        files, root = storage(folder)
        name = f"records-{part:06d}-{uuid.uuid4().hex}.bin"
        out, offset, before = None, 0, 0
        try:
            for batch in batches:
                ids = batch.column(0)
                given = np.array(ids.is_valid())
                number = ids.fill_null(0).to_numpy()
                for a, some in text_runs(batch.column(1), CHUNK_CHARS):
                    b = a + len(some)
                    tokens, count = own.encode_texts(some)
                    if end_id is not None:
                        tokens = np.insert(tokens, np.cumsum(count), end_id)
                        count = count + 1
                    data, length = frame(number[a:b], given[a:b], tokens, count, width)
                    if out is None:
                        files.create_dir(root, recursive=True)
                        out = files.open_output_stream(f"{root}/{name}")
                    out.write(data)
                    ends = np.cumsum(length + FRAME)
                    sums = np.cumsum(count)
                    n = b - a
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, part, np.int32)), pa.array([name] * n, pa.string()),
                         pa.array(offset + ends - length - FRAME), pa.array(length), ids.slice(a, n),
                         pa.array(count), pa.array(before + sums - count)],
                        names=["part", "file", "offset", "length", "doc_id", "n_tokens", "before"])
                    offset, before = offset + int(ends[-1]), before + int(sums[-1])
        finally:
            if out is not None:
                out.close()

    # written once: the rows that Spark commits name the files of committed tasks only
    local = materialise(map_arrow(dealt, run, _LOCAL), "records-index")
    # one row per file, at most as many as shuffle partitions
    files = local.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    until = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("part", F.coalesce(F.sum("n").over(until), F.lit(0)).alias("base"))
    index = local.join(F.broadcast(base), "part").select(
        "part", "file", "offset", "length", "doc_id", "n_tokens", (F.col("base") + F.col("before")).alias("start"))
    place = f"{folder.rstrip('/')}/index"
    index.write.mode("overwrite").option("compression", "zstd").parquet(place)
    return spark.read.schema(index.schema).parquet(place)


def shuffled(index: DataFrame, seed: int) -> DataFrame:
    """The index in a random order, another one for every ``seed``: records
    are dealt to tasks by a hash of their place and sorted by it."""
    key = F.xxhash64(F.lit(seed), "file", "offset")
    dealt = index.withColumn("_key", key).repartition(shuffle_partitions(index.sparkSession), "_key")
    return dealt.sortWithinPartitions("_key", "file", "offset").drop("_key")


def _runs(files: list[str], offset: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, int]]:
    """Index ranges of records that follow each other in one file, of about
    ``READ_BYTES``."""
    a = 0
    for i in range(1, len(files) + 1):
        if (i == len(files) or files[i] != files[a] or offset[i] != offset[i - 1] + length[i - 1] + FRAME
                or offset[i] + length[i] - offset[a] > READ_BYTES):
            yield a, i
            a = i


def read_records(index: DataFrame, folder: str, digest: bool = False) -> DataFrame:
    """The records that ``index`` names, in its order within a task: ``doc_id``
    and ``ids`` as the file holds them and ``start`` from the index; with
    ``digest`` ``n_tokens`` and ``ids_crc32`` (unsigned CRC-32 of the ids as
    little-endian 32-bit integers) instead of ``ids``.

    Records that follow each other in a file are read at once, about
    ``READ_BYTES``; a longer record is read alone.  A record whose length or
    checksum is wrong, or a missing file, is an error.  Index rows may be
    filtered, repeated or shuffled; no rows give no records.
    """
    src = index.select("file", "offset", "length", "start")
    schema = "doc_id long, start long, " + ("n_tokens long, ids_crc32 long" if digest else "ids array<int>")

    def run(batches):
        files, root = storage(folder)
        handles: dict = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            offset, length = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for a, b in _runs(names, offset, length):
                if names[a] not in handles:
                    if len(handles) >= OPEN_FILES:
                        handles.pop(next(iter(handles))).close()
                    handles[names[a]] = files.open_input_file(f"{root}/{names[a]}")
                handle = handles[names[a]]
                data = handle.read_at(int(offset[b - 1] + length[b - 1] + FRAME - offset[a]), int(offset[a]))
                doc_id, known, ids = unframe(data, offset[a:b] - offset[a], length[a:b])
                arrays = [pa.array(doc_id, mask=~known), batch.column(3).slice(a, b - a)]
                if digest:
                    arrays += [pa.array([len(x) for x in ids], pa.int64()),
                               pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
                else:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                    flat = np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", *(["n_tokens", "ids_crc32"] if digest else ["ids"])])
        for h in handles.values():
            h.close()

    return map_arrow(src, run, schema)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared storage; it goes when the driver
    process ends."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-records-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return folder


def written_and_read(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from record
    files written and read back."""
    folder = scratch_folder(docs.sparkSession)
    return read_records(write_records(docs, path, folder, end_id), folder, digest=True)
