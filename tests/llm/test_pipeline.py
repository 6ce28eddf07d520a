"""Every stage against a brute-force version on its own input."""

import pytest

import corpus_pipeline as pipeline
from querylens.llm import bpe, mixing, secrets, toxicity
from querylens.llm.common import materialise

from ..conftest import SMALL
from .test_texts import brute_jaccard


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet").select(*pipeline.COLUMNS), []
    planted = [(10**6 + i, f"note {i} on {'abcdefgh'[i]} password=deadbeef{i:04d} and AKIA{'ABCDEFGH' * 2} end {i}", "en", "src0", 70) for i in range(8)]
    docs = docs.union(spark.createDataFrame(planted, docs.schema))
    for name, stage in pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, SMALL), f"test-{name}")
        out.append((before, docs))
    return out


def rows(df):
    return sorted(tuple(r) for r in df.select(*pipeline.COLUMNS).collect())


def test_columns(stages):
    for _, after in stages[:-1]:
        assert after.columns == pipeline.COLUMNS
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "bpe"]


def test_toxic_documents_go(spark, stages):
    before, after = stages[0]
    model = toxicity.train(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
    number = model.table()
    want = [r for r in rows(before) if model.score_texts([r[1] or ""], number)[0] < 0.5]
    assert rows(after) == want and len(want) < before.count()


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    found = brute_jaccard([(r[0], r[1]) for r in rows(before)])
    want = [r for r in rows(before) if found[r[0]][1] == r[0]]
    assert rows(after) == want and len(want) < before.count()


def test_secrets_are_masked(stages):
    before, after = stages[2]
    spans = {r.doc_id: r.spans for r in secrets.scan(before, secrets.model(before)).collect()}
    assert any(spans.values())
    for (i, text, *rest), (j, clean, *other) in zip(rows(before), rows(after)):
        out, at = [], 0
        for s in spans[i]:
            if s.start >= at:
                out += [text[at:s.start], secrets.MASK]
            at = max(at, s.end)
        assert i == j and clean == "".join(out) + text[at:]
        assert other == [*rest[:2], len(clean)] if spans[i] else other == rest


def test_documents_are_repeated(spark, stages):
    before, after = stages[3]
    rates, _ = mixing.mix(before, spark.read.parquet(f"{SMALL}/labels.parquet"), least=1.0, grow=True)
    times = {r.doc_id: r.c for r in rates.select("doc_id", mixing.copies().alias("c")).collect()}
    assert rows(after) == sorted(r for r in rows(before) for _ in range(times[r[0]]))
    assert after.count() > before.count()


def test_texts_become_ids(stages, vocabulary):
    before, after = stages[4]
    tokens = bpe.tokenizer(vocabulary)
    want = sorted((r[0], r[2], r[3], tokens.encode_texts([r[1]])[0].tolist()) for r in rows(before))
    got = sorted((r.doc_id, r.lang, r.source, r.ids) for r in after.collect())
    assert got == want and all(r.n_tokens == len(r.ids) for r in after.collect())


def test_run_applies_the_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, SMALL), f"run-{name}")
    key = lambda df: sorted((r.doc_id, r.n_tokens) for r in df.collect())
    assert key(pipeline.run(spark, SMALL)) == key(docs)


def test_odd_rows(table, spark):
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "some words without an id", "en", "s", 3),
           (3, "password=abcdef123 " * 3, "de", None, 57), (3, "password=abcdef123 " * 3, "de", None, 57), (4, "long " * 40_000, "en", "s", 200_000)]
    docs = table(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        now = some
        for name, stage in pipeline.STAGES:
            now = materialise(stage(spark, now, SMALL), f"odd-{name}")
        found = now.collect()
        if some is not docs:
            assert found == []
        else:
            assert {r.doc_id for r in found} == {1, 2, 3, 4, None}
            assert {r.doc_id for r in found if not r.ids} == {1, 2}
