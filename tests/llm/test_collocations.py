import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from querylens.llm import collocations as co


def counted(rows) -> tuple[Counter, Counter]:
    """f by (lang, phrase) and n by lang, as defined."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, " ".join(words[i:i + k])) for i in range(len(words) - k + 1))
    return f, Counter({k: v for k, v in n.items() if v})


def expected(rows, top=2000) -> list[tuple]:
    f, n = counted(rows)
    cand = {k: a for k, a in f.items() if a >= 10 and k[1].count(" ")}
    found = []
    for (lang, phrase), a in cand.items():
        w = phrase.split(" ")
        inside = lambda q: any(q.split(" ")[i:i + len(w)] == w for i in range(q.count(" ") + 2 - len(w)))
        if any(lg == lang and q.count(" ") >= len(w) and 100 * b >= 50 * a and inside(q) for (lg, q), b in cand.items()):
            continue
        cuts = [(f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]) for k in range(1, len(w))]
        score, k = min((10**6 * a * a // (x * y), k) for k, (x, y) in enumerate(cuts))
        found.append((lang, phrase, a, *cuts[k], n[lang], score))
    out = []
    for lang in n:
        own = sorted((r for r in found if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(lang, i, *r[1:]) for i, r in enumerate(own[:top], 1)]
    return sorted(out)


def got(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(size=150):
    rnd = random.Random(size)
    words = ["New", "york", "the", "city", "of", "São", "paulo", "ÀÉ", "x", "\x85", "a\xa0b", "-", "'s"]
    phrase = lambda: rnd.choice(["the New york city ", "of the ", "São  paulo\t", "new York", " "])
    text = lambda: "".join(phrase() + rnd.choice(words) + rnd.choice([" ", " ", ". ", ", ", "\n", "\r\n", "  ", "?"]) for _ in range(40))
    return [(rnd.choice(["en", "en", "en", "pt", None]), text()) for _ in range(size)]


ODD = [("en", None), ("de", ""), (None, "."), ("fr", "allein"), ("pt", "x" * 70_000 + " the new"), ("en", "the city " * 20_000), ("und", "of the")]


@pytest.mark.parametrize("partition,fan", [(16 << 20, 256), (4_000, 5)])
def test_equals_brute_force(table, monkeypatch, partition, fan):
    """With one level of partitions and with several."""
    monkeypatch.setattr(co, "PARTITION_BYTES", partition)
    monkeypatch.setattr(co, "FAN", fan)
    rows = corpus(60 if fan == 5 else 150) + ([(a, b and b[:3_000]) for a, b in ODD] if fan == 5 else ODD)
    rows += rows[:3]
    df = table(rows, "lang string, text string").repartition(3)
    assert got(co.collocations(df)) == expected(rows)
    few = got(co.collocations(df, top=3))
    assert few == expected(rows, 3)


def test_long_texts_in_stretches(monkeypatch):
    """Phrases across the cuts are counted once."""
    rnd = random.Random(4)
    text = "".join(rnd.choice(["a", "b ", " ", "c. ", "d\n", "é ", "\t", "x" * 90]) for _ in range(3_000))
    want = counted([("en", text)])
    for stretch in (1, 50, 1_000):
        monkeypatch.setattr(co, "STRETCH", stretch)
        assert b"".join(p for p, _ in co.stretches(text.encode())) == text.encode()
        counter, total = co.Counter(3), Counter()
        for some in (counter.count("en", text.encode()), counter.finish()):
            for _, _, phrases, counts in some:
                total.update(dict(zip((("en", p.decode()) for p in phrases.to_pylist()), counts.tolist())))
        assert total == want[0] and dict(counter.totals) == dict(want[1])


def test_runs_merged_in_pieces(monkeypatch):
    monkeypatch.setattr(co, "MERGE_ROWS", 3)
    rnd = random.Random(6)
    rows, want = [], Counter()
    for key in range(4):
        for _ in range(rnd.randrange(1, 12)):
            run = Counter(rnd.choices([b"a", b"a b", b"c", b"d e f"], k=5))
            rows.append((key, key, "en", *co._packed_run(pa.array(sorted(run), pa.large_binary()), np.array([run[p] for p in sorted(run)]))))
            want.update({(key, p): n for p, n in run.items()})
    types = (pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + 4]), types)],
                                          names=["k", "part", "lang", "words", "lengths", "counts"]) for i in range(0, len(rows), 4)]
    found = {(part, p): n for part, _, phrases, counts in co._merged_groups(batches) for p, n in zip(phrases.to_pylist(), counts.tolist())}
    assert found == want


def test_empty_tables(table):
    df = table([("en", "a b")], "lang string, text string")
    assert got(co.collocations(df.limit(0))) == [] and got(co.collocations(df)) == []


@pytest.mark.parametrize("entries,burst,known", [(40, 4, 10_000), (400_000, 2, 10_000), (40, 1_000, 20), (400_000, 2_048, 180_000)])
def test_spilled_runs_add_up(monkeypatch, entries, burst, known):
    for name, value in (("ENTRIES", entries), ("BURST", burst), ("WORDS_KNOWN", known), ("STRETCH", 100)):
        monkeypatch.setattr(co, name, value)
    rnd = random.Random(2)
    rows = [(rnd.choice(["en", "de"]), " ".join(rnd.choice("abcdefg") + rnd.choice(["", "", str(rnd.randrange(20))]) for _ in range(30))) for _ in range(60)]
    counter, total, spills = co.Counter(4), Counter(), 0
    for lang, text in rows:
        for lg, part, phrases, counts in counter.count(lang, text.encode()):
            assert phrases.to_pylist() == sorted(set(phrases.to_pylist()))
            total.update(dict(zip(((lg, p.decode()) for p in phrases.to_pylist()), counts.tolist())))
            spills += 1
        assert sum(t.entries for t in counter.tries.values()) <= entries
    for lg, _, phrases, counts in counter.finish():
        total.update(dict(zip(((lg, p.decode()) for p in phrases.to_pylist()), counts.tolist())))
    want = counted(rows)
    assert total == want[0] and dict(counter.totals) == dict(want[1]) and (spills > 3) == (entries == 40)


def test_merged():
    run = lambda d: (pa.array([k for k, _ in sorted(d.items())], pa.large_binary()), np.array([v for _, v in sorted(d.items())]))
    a, b, c = {b"a": 1, b"b c": 2}, {b"b": 5, b"b c": 7, "é".encode(): 1}, {b"a": 3}
    phrases, counts = co.merged([run(a), run(b), run(c)])
    assert dict(zip(phrases.to_pylist(), counts.tolist())) == {b"a": 4, b"b": 5, b"b c": 9, "é".encode(): 1}
    assert phrases.to_pylist() == sorted(phrases.to_pylist())


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits."""
    df = spark.createDataFrame([(3_000_000_019, 3_000_000_100, 3_000_000_033)], "a long, l long, r long")
    assert df.select(co._score("l", "r").alias("s")).first().s == 10**6 * 3_000_000_019**2 // (3_000_000_100 * 3_000_000_033)
