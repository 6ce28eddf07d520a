import random
import zlib

import numpy as np
import pytest

from querylens.llm import queries, records

from ..conftest import SMALL

TEXTS = [None, "", " ", "a b", "x<|endoftext|> y", "\n\n  x", "日本語 テキスト", "!\x1c! . .", "word " * 9_000, "z" * 30_000, "　é  'll\t\t"]


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary)


def slow_crc32c(data: bytes) -> int:
    state = 0xFFFFFFFF
    for byte in data:
        state ^= byte
        for _ in range(8):
            state = (state >> 1) ^ (records.POLYNOMIAL if state & 1 else 0)
    return state ^ 0xFFFFFFFF


def test_checksum():
    assert slow_crc32c(b"123456789") == 0xE3069283        # published check value
    count = np.array([0, 1, 2, 3, 5, 8, 13, 100, 1, 0, 7, 64])
    words = np.random.default_rng(1).integers(0, 2**32, count.sum(), dtype=np.uint32)
    ends = np.cumsum(count)
    assert records.crc32c(words, count).tolist() == [slow_crc32c(words[e - k:e].tobytes()) for k, e in zip(count, ends)]
    assert records.crc32c(words[:0], np.zeros(0, int)).tolist() == []


def test_units_equal_whole_texts(library, vocabulary, monkeypatch):
    rnd = random.Random(3)
    parts = [" ", "  ", "\n", "a", "b c", "'s", "　", " ", "\x1c", "\x85", "x<|endoftext|>", "é", "日本", " \n", "\t", "1", "!", "!\x1c!", ". .", "'ll"]
    texts = [t or "" for t in TEXTS] + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(1500)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for units in (records.UNITS, 10):
        monkeypatch.setattr(records, "UNITS", units)
        own = records.UnitEncoder(vocabulary)
        got = []
        for i in range(0, len(texts), 100):
            ids, count = own.encode_texts(texts[i:i + 100])
            got += [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
        assert got == want


@pytest.mark.parametrize("width", [2, 4])
def test_frames(width):
    count = np.array([0, 1, 2, 5])
    ids = np.arange(8) + (70_000 if width == 4 else 0)
    data, length = records.frame(np.array([5, -1, 0, 2**40]), np.array([True, True, False, True]), ids, count, width)
    offset = np.cumsum(length + records.FRAME) - length - records.FRAME
    doc_id, known, found = records.unframe(data, offset, length)
    assert doc_id.tolist() == [5, -1, 0, 2**40] and known.tolist() == [True, True, False, True]
    assert [x.tolist() for x in found] == [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
    # the frame as published: length, its masked checksum, payload, its masked checksum
    mask = lambda c: ((c >> 15 | c << 17) + records.MASK_ADD) & 0xFFFFFFFF
    n = int.from_bytes(data[:8], "little")
    assert n == length[0] and int.from_bytes(data[8:12], "little") == mask(slow_crc32c(data[:8]))
    assert int.from_bytes(data[12 + n:16 + n], "little") == mask(slow_crc32c(data[12:12 + n]))
    for at in (0, 9, 14, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(records.Damaged):
            records.unframe(bytes(broken), offset, length)
    with pytest.raises(records.Damaged):
        records.unframe(data[:-4], offset, length)


def test_rows(table, library, vocabulary, monkeypatch):
    rows = [*((10 - i, t) for i, t in enumerate(TEXTS)), (3, "again"), (3, "again"), (None, "no id")]
    df = table(rows, "doc_id long, text string").repartition(5)
    folder = records.scratch_folder(df.sparkSession)
    index = records.write_records(df, vocabulary, folder, end_id=2)
    encode = lambda t: library.encode(t or "", add_special_tokens=False).ids + [2]
    got = [r.asDict() for r in records.read_records(index, folder).collect()]
    assert sorted((r["doc_id"] is None, r["doc_id"], r["ids"]) for r in got if r["doc_id"] is not None) == \
        sorted((False, i, encode(t)) for i, t in rows if i is not None)
    # starts follow the documents' order, rows without doc_id last
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in by_start] == [sum(len(x["ids"]) for x in by_start[:k]) for k in range(len(by_start))]
    assert [r["doc_id"] for r in by_start[:-1]] == sorted(i for i, _ in rows if i is not None) and by_start[-1]["doc_id"] is None
    # shuffled reads: other orders, equal records
    monkeypatch.setattr(records, "READ_BYTES", 64)
    orders = [[(r.doc_id, r.start, tuple(r.ids)) for r in records.read_records(records.shuffled(index, seed), folder).collect()] for seed in (1, 2, 2)]
    assert orders[0] != orders[1] == orders[2] and sorted(orders[0], key=str) == sorted(orders[1], key=str) == \
        sorted(((r["doc_id"], r["start"], tuple(r["ids"])) for r in got), key=str)
    assert records.read_records(index.where("doc_id = 3"), folder).count() == 3
    # without an end id empty texts have empty records; no rows, no files
    plain = records.scratch_folder(df.sparkSession)
    assert sorted(len(r.ids) for r in records.read_records(records.write_records(df, vocabulary, plain), plain).collect())[:2] == [0, 0]
    assert records.written_and_read(df.limit(0), vocabulary).count() == 0


def test_query(spark, library):
    got = {r.doc_id: r for r in queries.op11_binary_records(spark, SMALL).collect()}
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    assert len(got) == len(docs)
    start = 0
    for (i, _), e in zip(docs, library.encode_batch([t for _, t in docs], add_special_tokens=False)):
        ids = np.array([*e.ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_units_of_letters_are_not_split(library, vocabulary):
    letters = [chr(c) for c in range(ord(records.LATIN_END))]
    own = records.UnitEncoder(vocabulary)
    assert all(x.isalpha() == bool(records.regex.fullmatch(r"\p{L}", x)) for x in letters)
    split, seen = own.split, []
    own.split = lambda unit: seen.append(unit) or split(unit)
    texts = ["plain words, and naïve Ärger ªº only", " white\n ends  ", "a(b) c(b) d(b)"]
    for _ in range(2):
        ids, count = own.encode_texts(texts)
        assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]
        assert count.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert not {"plain", " and", " naïve", " Ärger", " ªº", " only"} & set(seen)
    assert {"(", "b", ")"} <= set(own.pieces)


def test_words_are_looked_up_once_per_call(vocabulary):
    own, looked = records.UnitEncoder(vocabulary), []

    class Counted(records._Numbers):
        def __getitem__(self, unit):
            looked.append(unit)
            return super().__getitem__(unit)

    own.spaced = Counted(own, " ")
    ids, count = own.encode_texts(["x same same same y"] * 50)
    assert looked.count("same") == 1 and count.tolist() == [len(ids) // 50] * 50
