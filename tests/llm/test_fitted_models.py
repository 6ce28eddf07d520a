"""The fitted parts of the toxicity classifier and of the domain posteriors
against plain versions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from querylens.llm import mixing, toxicity

MASK = (1 << 64) - 1


def bucket(gram: str) -> int:
    h = ord(gram[0])
    for c in gram[1:]:
        h = (h * 0x9E3779B97F4A7C15 + ord(c)) & MASK
    return (((h ^ (h >> 29) ^ len(gram)) * 0xBF58476D1CE4E5B9) & MASK) >> (64 - toxicity.BUCKET_BITS)


def held(text: str) -> set[int]:
    t = "".join(" " if c in " \t\n\v\f\r" else c for c in text.lower())
    return {bucket(t[i:i + n]) for n in toxicity.NGRAMS for i in range(len(t) - n + 1)}


@pytest.fixture(scope="module")
def examples():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randrange(2, 7)))
    rows = [(i, " ".join(word() for _ in range(8)) + (" Vile\tslur " if i % 3 == 0 and rnd.random() < 0.8 else "")) for i in range(160)]
    marks = [(i, int(i % 3 == 0)) for i, _ in rows]
    return rows, marks


def test_toxicity_features_and_fit_equal_brute_force(table, examples):
    rows, marks = examples
    model = toxicity.train(table(rows, "doc_id long, text string"), table(marks, "doc_id long, toxic int"), features=40)
    train = [(held(t), y) for (i, t), (_, y) in zip(rows, marks) if zlib.crc32(str(i).encode()) % 5]
    n = Counter(y for _, y in train)
    per = {y: Counter(b for s, z in train if z == y for b in s) for y in (0, 1)}
    told = {}
    for b in set(per[0]) | set(per[1]):
        p, q = (per[1][b] + 1) / (n[1] + 2), (per[0][b] + 1) / (n[0] + 2)
        both = (per[0][b] + per[1][b] + 1) / (n[0] + n[1] + 2)
        told[b] = abs(p - q) / math.sqrt(both * (1 - both) * (1 / n[1] + 1 / n[0])), math.log(p / q)
    order = sorted(told, key=lambda b: (-told[b][0], b))
    assert (model.n_rows, model.n_toxic) == (len(train), n[1])
    # buckets in order of telling, up to rounding of equal ones
    assert np.allclose([told[int(b)][0] for b in model.buckets], [told[b][0] for b in order[:40]])
    assert np.allclose(model.ratios, [told[int(b)][1] for b in model.buckets])
    # penalised logistic regression on presence times ratio, solved by Newton steps
    x = np.array([[1.0, *(told[int(b)][1] * (int(b) in s) for b in model.buckets)] for s, _ in train])
    y = np.array([z for _, z in train], float)
    penalty = 1e-4 * np.diag([0.0, *np.ones(40)])
    w = np.zeros(41)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + penalty + 1e-10 * np.eye(41), x.T @ (p - y) / len(y) + penalty @ w)
        w -= step / max(1.0, np.abs(step).max())
    loss = lambda v: np.mean(np.logaddexp(0, x @ v) - y * (x @ v)) + v @ penalty @ v / 2
    mine = np.array([model.intercept, *(model.weights / model.ratios)])
    assert loss(w) <= loss(mine) + 1e-9 and loss(mine) < loss(w) + 5e-3
    # scores follow from presence alone
    got = model.score_texts([t for _, t in rows[:20]], model.table())
    want = [1 / (1 + math.exp(-model.intercept - sum(v for b, v in zip(model.buckets, model.weights) if int(b) in held(t)))) for _, t in rows[:20]]
    assert np.allclose(got, want)


def test_domain_posteriors_equal_brute_force(table):
    rnd = random.Random(5)
    lexicon = {"de": ["und", "der", "haus", "baum"], "en": ["and", "the", "house", "tree"], "fr": ["et", "le", "maison", "arbre"]}
    common = ["a", "b", "x\x01y", "10"]
    text = lambda d, k: " ".join(rnd.choice(lexicon[d] + common).upper() if rnd.random() < 0.2 else rnd.choice(lexicon[d] + common) for _ in range(k))
    rows = [(i, text(d, rnd.choice([0, 3, 40])), d) for i, d in enumerate(rnd.choices(list(lexicon), [3, 2, 1], k=90))]
    rows += [(100, None, "de"), (101, "the und", None), rows[4]]
    size = 7
    labelled = table([(t, d) for _, t, d in rows], "text string, domain string")
    model = mixing.train(labelled, vocabulary=size)
    split = lambda t: [w for w in (t or "").lower().replace("\t", " ").split(" ") if w]
    domains = sorted(lexicon)
    docs = Counter(d for _, _, d in rows if d)
    counts = {d: Counter(w for _, t, e in rows if e == d for w in split(t)) for d in domains}
    words = {d: sum(counts[d].values()) for d in domains}
    total = sum(words.values())
    every = {w: sum(counts[d][w] for d in domains) for d in domains for w in counts[d]}
    told = {w: sum(counts[d][w] * math.log((counts[d][w] + 1e-9) / n * (total / words[d])) for d in domains) for w, n in every.items()}
    logs = {w: [math.log((counts[d][w] + mixing.SMOOTHING) / (words[d] + mixing.SMOOTHING * size)) for d in domains] for w in told}
    found = {r.word: [r.l0, r.l1, r.l2] for r in model.vocabulary.collect()}
    assert model.domains == domains and np.allclose(model.priors, [math.log(docs[d] / sum(docs.values())) for d in domains])
    best = sorted(told, key=lambda w: (-told[w], w))[:size]
    assert np.allclose(sorted(told[w] for w in found), sorted(told[w] for w in best)) and len(found) == size
    assert all(np.allclose(found[w], logs[w]) for w in found)
    df = table([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {(r.doc_id, r.n_tokens): r for r in mixing.posteriors(df, model).collect()}
    assert len(got) == len({(i, t) for i, t, _ in rows})
    for i, t, _ in rows:
        ws = split(t)
        hits = [w for w in ws if w in found]
        z = np.array(model.priors) + min(1.0, mixing.EVIDENCE / max(len(hits), 1)) * sum((np.array(found[w]) for w in hits), np.zeros(3))
        e = np.exp(z - z.max())
        r = got[i, len(ws)]
        assert np.allclose(r.posterior, e / e.sum()) and r["rows"] == sum((a, b) == (i, t) for a, b, _ in rows)
