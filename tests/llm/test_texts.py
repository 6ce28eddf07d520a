"""Substring dedup, Jaccard join and the hashing below them."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from querylens.llm import jaccard, substrings, words
from querylens.llm.common import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rnd, n, vocabulary=4000):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def corpus():
    rnd = random.Random(11)
    passage, long_one = sentence(rnd, 60), sentence(rnd, 400)
    near = long_one.split()
    rows = [(0, None), (1, ""), (2, " \n\t\x0b "), (3, sentence(rnd, 3)), (4, "one two three four"), (5, "one  two three four"),
            (6, long_one), (7, long_one), (7, long_one), (8, long_one.replace(" ", "\n")), (None, long_one), (None, None)]
    for i in range(9, 30):
        w = list(near)
        w[rnd.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(w)))
    for i in range(30, 60):
        rows.append((i, sentence(rnd, rnd.randrange(0, 80)) + " " + passage + " " + sentence(rnd, rnd.randrange(0, 80))))
    rows.append((60, "la " * 300))
    rows.append((61, "la " * 200 + "ende"))
    rows.append((62, sentence(rnd, 30_000)))
    rows.append((63, "ünïcode wörd   x " * 40))
    rnd.shuffle(rows)
    return rows


def brute_substrings(rows, window):
    first, texts = {}, [(i, WORD.findall(t or "")) for i, t in rows]

    def windows(ws, n):
        return [tuple(ws[k:k + n]) for k in range(len(ws) - n + 1)]

    out = []
    sizes = [window]
    while sizes[-1] * 2 <= max(len(ws) for _, ws in texts):
        sizes.append(sizes[-1] * 2)
    for n in sizes:
        for i, ws in texts:
            if i is not None:
                for w in windows(ws, n):
                    first[w] = min(first.get(w, i), i)
    for i, ws in texts:
        gone, deepest = [False] * len(ws), 0
        for n in sizes if i is not None else ():
            for k, w in enumerate(windows(ws, n)):
                if first[w] < i:
                    deepest = n
                    if n == window:
                        gone[k:k + n] = [True] * n
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        out.append((-1 if i is None else i, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), deepest))
    return sorted(out)


def test_substrings_equal_brute_force(table):
    rows = [(i, t if t is None else " ".join(WORD.findall(t)[:1500]) if i == 62 else t) for i, t in corpus()]
    for window in (50, 7):
        df = table(rows, "doc_id long, text string").repartition(5)
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest(),
                      r.longest_repeat) for r in substrings.substring_dedup(df, window).collect())
        assert got == brute_substrings(rows, window)


def test_windows_shared_inside_another_kind_of_run(table):
    """The end of T in document 1's first passage lies in document 3 only
    within the other kind of run."""
    rnd, rows = random.Random(12), []
    for g in range(0, 60, 4):
        p1, p2, t, c1, c2 = (sentence(rnd, n, 10 ** 6) for n in (30, 33, 70, 22, 30))
        rows += [(g + 1, f"{p2} {t} {c2} {p1} {t} {c1}"), (g + 3, f"{p2} {t} {c1}")]
    got = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest(), r.longest_repeat)
                 for r in substrings.substring_dedup(table(rows, "doc_id long, text string")).collect())
    assert got == brute_substrings(rows, 50)


def test_removed_spans_name_the_removed_words(table):
    for r in substrings.substring_dedup(table(corpus(), "doc_id long, text string")).collect():
        assert r.n_removed == sum(b - a for a, b in r.removed_spans)


def test_empty_tables(table):
    df = table([(1, "x")], "doc_id long, text string").limit(0)
    assert substrings.substring_dedup(df).count() == 0
    assert jaccard.jaccard_links(df).count() == 0
    nothing = table([(1, None), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substrings.substring_dedup(nothing).collect()) == [(1, 0), (2, 0)]
    assert sorted((r.doc_id, r.n_links, r.kept) for r in jaccard.jaccard_links(nothing).collect()) == [(1, 0, True), (2, 0, True)]


def brute_jaccard(rows):
    docs = {}
    for i, t in rows:
        ws = WORD.findall(t or "")
        if i is not None:
            docs[i] = {tuple(ws[k:k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()
    link = {i: {j for j in docs if j != i and docs[i] and docs[j] and len(docs[i] & docs[j]) / len(docs[i] | docs[j]) >= 0.8} for i in docs}
    comp = {}
    for i in sorted(docs):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in comp:
                comp[j] = i
                todo += link[j]
    return {i: (len(link[i]), comp[i]) for i in docs}


def test_jaccard_equals_brute_force(table):
    rows = corpus()
    want = brute_jaccard(rows)
    got = jaccard.jaccard_links(table(rows, "doc_id long, text string").repartition(7)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_links, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept and r.component_id is None and r.n_links == 0 for r in got if r.doc_id is None)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_jaccard_in_small_blocks(table, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rows = corpus()
    got = jaccard.jaccard_links(table(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_links, r.component_id) for r in got if r.doc_id is not None} == brute_jaccard(rows)


def test_depths_reach_the_recall():
    pairs = {(t, d): 1000 * (t + 1) // d for t in range(jaccard.TREES) for d in range(jaccard.MIN_DEPTH, jaccard.MAX_DEPTH + 1)}
    for target in (0.5, 0.9, 0.999, 0.9999):
        depths = jaccard.choose_depths(pairs, 0.8, target)
        assert jaccard.recall_at(depths, 0.8) >= target
        longer = [d + (t == depths.index(min(depths))) for t, d in enumerate(depths)]
        assert min(depths) == jaccard.MAX_DEPTH or jaccard.recall_at(longer, 0.8) < jaccard.recall_at(depths, 0.8)


def test_word_hashes_do_not_depend_on_the_chunk():
    rnd = random.Random(2)
    texts = [None, "", "a b  c", *[sentence(rnd, rnd.randrange(0, 50)) for _ in range(40)], "é　ü x\ty\n"]
    col = pa.array(texts)

    def hashes(limit):
        out = []
        for i, j, data, offs in words.chunks(col, limit):
            w = words.Words(data, offs)
            h = w.hashes()
            out += [h[a:b].tolist() for a, b in zip(w.first, w.first[1:])]
        return out

    whole = hashes(1 << 20)
    assert hashes(10) == hashes(200) == whole
    assert [len(h) for h in whole] == [len(WORD.findall(t or "")) for t in texts]
    by_word = {}
    for t, h in zip(texts, whole):
        for w, x in zip(WORD.findall(t or ""), h):
            assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)


def test_sliding_min():
    h = np.random.default_rng(1).integers(0, 1 << 62, 200).astype(np.uint64)
    for w in (1, 2, 3, 26, 200):
        assert words.sliding_min(h, w).tolist() == [h[i:i + w].min() for i in range(200 - w + 1)]


def test_components(spark):
    rnd = random.Random(4)
    chain = [(i, i + 1) for i in range(0, 60)] + [(100 + rnd.randrange(40), 100 + rnd.randrange(40)) for _ in range(30)] + [(5, 5)]
    star = [(200, i) for i in range(201, 260)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain + star, "src long, dst long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in chain + star:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_a_recall_out_of_reach_is_an_error():
    assert jaccard.recall_at([jaccard.MIN_DEPTH] * jaccard.TREES, 0.5) < 0.9
    with pytest.raises(ValueError, match="recall"):
        jaccard.choose_depths({}, 0.5, 0.9)
