import hashlib
import random

import numpy as np
import pytest

from querylens.llm import bpe

ODD = [None, "", " ", "a", "\n\n  x", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "é" * 300, "x" * 5000, " " * 700 + "y",
       "日本語テキスト 1234567890!!!???", "ab" * 200 + "'s it's I'll", "​́   x", "😀😀😀", "a" * 40_000, "ab " * 20_000]


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary)


def random_texts(n=300):
    rnd = random.Random(3)
    pick = lambda: chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 1500), rnd.randrange(0x3000, 0x3100), 10, 32, 32]))
    return ["".join(pick() for _ in range(rnd.randrange(1, 300))) for _ in range(n)] + \
           ["".join(rnd.choice("etaoin") for _ in range(rnd.randrange(60, 400))) for _ in range(50)]


def test_equals_the_library(library, vocabulary):
    texts = [t or "" for t in ODD] + random_texts()
    mine = bpe.ByteBPE(vocabulary)
    ids, count = mine.encode_texts(texts)
    ends = np.concatenate([[0], np.cumsum(count)])
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        own = ids[ends[i]:ends[i + 1]]
        assert e.ids == own.tolist()
        assert library.decode(e.ids, skip_special_tokens=False) == mine.decode_ids(own)


def test_heap_and_rank_array_agree(vocabulary):
    mine = bpe.ByteBPE(vocabulary)
    rnd = random.Random(5)
    for width in (1, 2, 3, 17, 64):
        words = [bytes(rnd.choice(b"etaoinshr ") for _ in range(width)) for _ in range(200)]
        ids, count = mine.merge_rows(mine.byte_id[np.array([list(w) for w in words])])
        ends = np.concatenate([[0], np.cumsum(count)])
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [mine.merge_long(w) for w in words]


def test_cache_limit_changes_nothing(vocabulary, monkeypatch):
    texts = random_texts(60)
    whole = bpe.ByteBPE(vocabulary).encode_texts(texts)[0].tolist()
    monkeypatch.setattr(bpe, "CACHE_PIECES", 10)
    monkeypatch.setattr(bpe, "STREAM_CHARS", 50)
    small = bpe.ByteBPE(vocabulary)
    assert [x for t in texts for x in small.encode_texts([t])[0].tolist()] == whole


def test_rows(table, library, vocabulary):
    rows = [*enumerate(ODD), (1, ""), (None, "no id")]
    df = table(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in bpe.round_trip_digest(df.where("doc_id is not null"), vocabulary).collect())
    want = []
    for i, t in rows[:-1]:
        e = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(e), sha(",".join(map(str, e))), sha(library.decode(e, skip_special_tokens=False))))
    assert got == sorted(want)
    assert bpe.encode(df.where("doc_id is null"), vocabulary).first().ids
    assert bpe.encode(df.limit(0), vocabulary).count() == 0


def test_decode(spark, vocabulary):
    ids = bpe.tokenizer(vocabulary).encode_texts(["Grüße, 世界"])[0].tolist()
    df = spark.createDataFrame([(1, ids), (2, []), (3, None), (4, ids[:-1])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode(df, vocabulary).collect()}
    assert got[1] == "Grüße, 世界" and got[2] == got[3] == "" and got[4].endswith("�")
