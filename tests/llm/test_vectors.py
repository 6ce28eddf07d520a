import math
import random
import re

import numpy as np
import pytest

from querylens.llm import common, topk, vectors


def rows_with_copies(dim=24, seed=3):
    rnd = np.random.default_rng(seed)
    rows, i = [], 0
    for _ in range(60):
        v = rnd.standard_normal(dim)
        rows.append((i, v.tolist()))
        i += 1
        for _ in range(int(rnd.integers(0, 4))):
            rows.append((i, (v + rnd.standard_normal(dim) * rnd.choice([0.0, 0.02, 0.06, 0.3])).tolist()))
            i += 1
    base = rows[0][1]
    rows += [(i, [1e300 * x for x in base]), (i + 1, [1e-300 * x for x in base]), (i + 2, None), (i + 3, [0.0] * dim),
             (i + 4, [math.nan] + base[1:]), (i + 5, [math.inf] + base[1:]), (i + 6, [None] + base[1:]), (i + 7, []),
             (i + 8, base[:5]), (i + 9, base[:5]), (0, base), (None, base), (i + 10, [-x for x in base])]
    return rows


def unit(v):
    if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
        return None
    m = max(map(abs, v))
    w = np.array(v) / m
    return w / np.linalg.norm(w)


def brute_links(rows, threshold):
    units = {i: u for i, v in rows if i is not None and (u := unit(v)) is not None}
    link = {i: set() for i, _ in rows if i is not None}
    for a in units:
        for b in units:
            if a != b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold:
                link[a].add(b)
    comp = {}
    for i in sorted(link):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in comp:
                comp[j] = i
                todo += link[j]
    return {i: (len(link[i]), comp[i], comp[i] == i) for i in link}


@pytest.mark.parametrize("block", [512, 3])
def test_links_equal_brute_force(table, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = rows_with_copies()
    got = vectors.embedding_links(table(rows, "vec_id long, embedding array<double>").repartition(5)).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == brute_links(rows, 0.95)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]


def test_exploded_and_packed_tables_are_not_broadcast(table, monkeypatch):
    """Spark's sizes of them are too low, whatever their number of rows."""
    plans, materialise = {}, common.materialise

    def seen(df, name, parts=None):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df, name, parts)

    monkeypatch.setattr(common, "materialise", seen)
    monkeypatch.setattr(vectors, "materialise", seen)
    rows = rows_with_copies()
    got = vectors.embedding_links(table(rows, "vec_id long, embedding array<double>"))
    last = got._jdf.queryExecution().executedPlan().toString()
    for plan in plans["vector-near"] + plans["vector-links"]:
        assert "Join" in plan and "Broadcast" not in plan
    outer = r"Join \[%s#\d+L\], \[%s#\d+L\], LeftOuter"      # its left side cannot be broadcast
    assert len(plans["cc"]) > 1 and all(re.search(outer % ("u", "u"), plan) for plan in plans["cc"][1:])      # links and each node's least
    assert len(re.findall(outer % ("node", "node"), last)) > 1      # components and their classes, classes and their links
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect() if r.vec_id is not None} == brute_links(rows, 0.95)


@pytest.mark.parametrize("dim", [1, 2, 3, 5])
def test_few_dimensions(table, dim):
    rnd = np.random.default_rng(dim)
    rows = [(i, rnd.standard_normal(dim).round(1).tolist()) for i in range(50)]
    got = vectors.embedding_links(table(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_links(rows, 0.95)


def test_empty(table):
    df = table([(1, [1.0])], "vec_id long, embedding array<double>").limit(0)
    assert vectors.embedding_links(df).count() == 0
    ints = topk.integer_vectors(df)
    assert topk.top_k(ints, ints).count() == 0


@pytest.mark.parametrize("n", [500, 60_000])
def test_recall_at_the_threshold(n):
    rnd = np.random.default_rng(n)
    u = vectors.unit_rows(rnd.standard_normal((400, 64)))
    w = rnd.standard_normal((400, 64))
    w = vectors.unit_rows(w - (w * u).sum(1, keepdims=True) * u)
    v = 0.95 * u + math.sqrt(1 - 0.95 ** 2) * w
    met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(vectors.filters_of(u, n), vectors.filters_of(v, n))]
    assert np.mean(met) >= 0.995


def test_recall_beyond_the_switch_to_three_blocks():
    n, rnd = 17_000_000, np.random.default_rng(17)
    u = vectors.unit_rows(rnd.standard_normal((600, 64)))
    w = rnd.standard_normal((600, 64))
    v = 0.95 * u + math.sqrt(1 - 0.95 ** 2) * vectors.unit_rows(w - (w * u).sum(1, keepdims=True) * u)
    assert all(len(np.intersect1d(a, b)) for a, b in zip(vectors.filters_of(u, n), vectors.filters_of(v, n)))


def test_list_decoding_is_complete():
    code = vectors.ProductCode(16, 40, 1)
    u = vectors.unit_rows(np.random.default_rng(2).standard_normal((20, 16)))
    r = u @ code.rotation
    a, b = (r[:, s] @ c.T for s, c in zip(code.blocks, code.codes))
    for i, got in enumerate(code.decode(u)):
        full = (a[i][:, None] + b[i]).ravel()
        assert got.tolist() == np.flatnonzero(full >= code.threshold).tolist()


def brute_top(rows, asked, k):
    out = []
    for qi, q in asked:
        scores = []
        for i, v in rows:
            if i != qi:
                scores.append((-sum(a * b for a, b in zip(q, v)), i))
        out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("rescore, rows_per_block", [(64, 4096), (6, 40), (0, 300)])
def test_top_k_equals_brute_force(table, monkeypatch, rescore, rows_per_block):
    monkeypatch.setattr(topk, "RESCORE", rescore)
    monkeypatch.setattr(topk, "ROWS", rows_per_block)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "PROBES", 6)
    rnd = random.Random(8)
    rows = [(i, [rnd.randrange(-60, 60) for _ in range(12)]) for i in range(300)]
    rows += [(i, rows[i - 300][1]) for i in range(300, 330)]                     # ties
    rows += [(330, [0] * 12), (331, [5]), (332, [])]                              # zero and short vectors
    df = table([*rows, rows[0], (None, [1] * 12), (400, None)], "vec_id long, v array<long>")
    asked = df.where("vec_id % 20 = 0 or vec_id >= 330 or vec_id is null")
    want = brute_top(rows, [(i, v) for i, v in rows if i % 20 == 0 or i >= 330], 5)
    assert sorted(tuple(r) for r in topk.top_k(df, asked, 5).collect()) == want


@pytest.mark.parametrize("rows_per_block", [4096, 10])
def test_every_vector_of_an_id_counts(table, monkeypatch, rows_per_block):
    monkeypatch.setattr(topk, "ROWS", rows_per_block)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rnd = random.Random(9)
    rows = [(i % 20, [rnd.randrange(-60, 60) for _ in range(6)]) for i in range(60)]      # three vectors an id
    df = table([*rows, rows[0]], "vec_id long, v array<long>")
    want = brute_top(rows, [r for r in rows if r[0] < 5], 5)
    assert sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id < 5"), 5).collect()) == want


@pytest.mark.parametrize("span", [8, 3])
def test_units_of_several_blocks_without_broadcast(table, monkeypatch, span):
    """Exploded query blocks look as small as the query set, whatever they come to."""
    monkeypatch.setattr(topk, "ROWS", 4)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "SPAN", span)
    rnd = random.Random(10)
    rows = [(i, [rnd.randrange(-6, 6) for _ in range(5)]) for i in range(300)]      # 75 blocks, many ties
    df = table(rows, "vec_id long, v array<long>")
    found = topk.top_k(df, df.where("vec_id % 6 = 0"), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan
    assert sorted(tuple(r) for r in found.collect()) == brute_top(rows, [r for r in rows if r[0] % 6 == 0], 5)


@pytest.mark.parametrize("most", [1, 2 ** 15 - 1, 2 ** 15, 2 ** 31, 2 ** 62])
def test_components_are_packed_whole(most):
    values = np.array([[0, 1, -1], [most, -most, 7]], np.int64)
    assert np.array_equal(topk._unpacked(topk._packed(values), 2, 3), values)


def test_top_k_with_few_candidates(table):
    df = table([(1, [1, 2]), (2, [3, -4])], "vec_id long, v array<long>")
    assert sorted(tuple(r) for r in topk.top_k(df, df, 5).collect()) == [(1, 1, 2, -5), (2, 1, 1, -5)]


def test_search_stops_early_but_only_on_proof(monkeypatch):
    rnd = np.random.default_rng(6)
    centre = rnd.integers(-100, 100, 32)
    values = np.vstack([rnd.integers(-20, 20, (3000, 32)), centre + rnd.integers(-5, 5, (10, 32))]).astype(np.int64)
    block = topk.Block(np.arange(len(values)), values, topk.impact_order(values))
    looked = []
    exact = topk.Block._exact
    monkeypatch.setattr(topk.Block, "_exact", lambda self, rows, q, k, own=None: (looked.append(len(rows)), exact(self, rows, q, k, own))[1])
    queries = np.vstack([centre, rnd.integers(-50, 50, (5, 32)), np.zeros((1, 32))]).astype(np.int64)
    found = block.search(queries, np.array([-1, 5, 6, 7, 8, 3005, 3]), 5)
    for q, own, (ids, scores) in zip(queries, [-1, 5, 6, 7, 8, 3005, 3], found):
        full = values @ q
        want = [i for i in np.lexsort((np.arange(len(values)), -full)) if i != own][:5]
        assert ids.tolist() == want and scores.tolist() == full[want].tolist()
    assert sum(looked) < 8 * len(values)      # the zero query ties everywhere and needs every vector


def test_integer_vectors(table):
    df = table([(1, [0.5, -0.001]), (2, [math.nan, 1.0]), (3, None), (4, [None, 1.0]), (5, [])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.v for r in topk.integer_vectors(df).collect()} == {1: [128, -1], 2: None, 3: None, 4: None, 5: []}
