import random
import re
import zlib
from collections import Counter

import pytest

from querylens.llm import queries, spelling

from ..conftest import SMALL


def near(a: str, b: str) -> bool:
    """One inserted, deleted or replaced code point, by definition."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def expected(n: dict) -> dict:
    """word -> (form, root, n, n_near, form_n), by comparing all pairs that
    share a word with one code point left out."""
    holes: dict = {}
    for w in n:
        for key in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            holes.setdefault(key, set()).add(w)
    links: dict = {w: set() for w in n}
    for some in holes.values():
        for a in some:
            links[a] |= {b for b in some if near(a, b)}
    out, form = {}, {}
    for w, others in links.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(links[w]), n[form[w]] if form[w] else None)
    return out


def counted(rows) -> dict:
    n: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def got(df) -> dict:
    rows = df.collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("letters,lengths", [("ab", (7, 10)), ("abcdé", (2, 5)), ("aà", (1, 12))])
def test_near_pairs(letters, lengths):
    rnd = random.Random(len(letters))
    for size in (1, 2, 40):
        long = {"".join(rnd.choice(letters) for _ in range(lengths[1])) for _ in range(size)}
        short = {"".join(rnd.choice(letters) for _ in range(lengths[1] - 1)) for _ in range(size)}
        pairs = [tuple(sorted(p)) for p in spelling.near_pairs(sorted(long), sorted(short))]
        words = sorted(long | short)
        assert sorted(pairs) == sorted((a, b) for i, a in enumerate(words) for b in words[i + 1:]
                                       if near(a, b) and (a in long or b in long))


def test_acceptor_is_minimal_and_complete():
    words = sorted({"tap", "taps", "top", "tops", "stop", "stops"})
    a = spelling.Acceptor(words)
    assert len(a.arcs) == 7      # start, s-t-o, t, ta/to, p, final p, final: rests are shared
    read = []
    todo = [("", a.start)]
    while todo:
        w, s = todo.pop()
        if a.final[s]:
            read.append(w)
        todo += [(w + c, t) for c, t in a.arcs[s].items()]
    assert sorted(read) == words


@pytest.mark.parametrize("limit", [2, 7, 20_000])
def test_large_partitions_lose_nothing(spark, limit):
    """Hot initial states: all words share their first and last half."""
    rnd = random.Random(limit)
    words = {"abcdefgh" + "".join(rnd.choice("xyz") for _ in range(rnd.randrange(2, 4))) + "hgfedcba" for _ in range(40)}
    words |= {"".join(rnd.choice("ab") for _ in range(rnd.randrange(7, 10))) for _ in range(60)} | {"z" * 40_000, "z" * 39_999}
    n = {w: rnd.choice([2, 3, 20, 30, 400]) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert got(spelling.group_variants(df, limit=limit)) == expected(n)


def test_rows(table):
    rnd = random.Random(1)
    base = ["Variant", "variante", "varianten", "GRÜSSEND", "grüssend", "anderthalb", "colour", "colours", "coloured"]
    rows = [(i, " ".join(rnd.choice(base) for _ in range(60))) for i in range(80)]
    rows += [(1, rows[1][1]), (None, "varjante varjante varjantes"), (900, None), (901, ""), (902, "1 2 3"), (903, "×÷×÷×÷×"), (904, "×÷×÷×÷×")]
    df = table(rows, "doc_id long, text string")
    want = expected(counted(rows))
    assert any(f for f, *_ in want.values())
    assert got(spelling.spelling_variants(df)) == want
    assert got(spelling.spelling_variants(df.limit(0))) == {}


def test_chains_end_at_the_root(spark):
    n = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2_000, "aaabbbb": 20_000, "aabbbbb": 199_999, "zzzzzzz": 5}
    assert got(spelling.group_variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == expected(n)
    ties = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaaaé": 20, "aaaaaac": 19}
    found = got(spelling.group_variants(spark.createDataFrame(list(ties.items()), "word string, n long")))
    assert found == expected(ties) and found["aaaaaaa"][0] == "aaaaaab"


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert got(queries.op12_spelling_variants(spark, SMALL)) == expected(counted(rows))
