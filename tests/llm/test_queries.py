"""Registered queries against their SQL, and results without SQL against
brute force on the smallest tables."""

import zlib

import pytest

from querylens.checks.oracle import compare
from querylens.llm import queries

from ..conftest import SMALL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, duck, name):
    info = compare(spark, duck, name, queries.QUERIES[name], queries.ORACLES[name], SMALL)
    assert info["schema_ok"] and info["rows_ok"] and info["values_ok"], info


def test_every_operator_has_a_query():
    numbers = {int(n[2:].split("_")[0]) for n in queries.QUERIES}
    assert numbers == set(range(1, 14))


def test_entry_registers_them():
    import __spark_entry__ as e
    assert set(queries.QUERIES) <= set(e.queries()) and "pipeline" in e.queries()
    assert set(queries.ORACLES) <= set(e.oracle_sql())


def test_toxicity_held_out(spark):
    sf = SMALL.replace("0.001", "0.1")
    found = {r.doc_id: r for r in queries.op8_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(found) == 10_000
    held = [(found[i], y) for i, y in labels.items() if found[i].held_out]
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    toxic = [r.predicted for r, y in held if y]
    clean = [r.predicted for r, y in held if not y]
    # 280 toxic rows in four languages are few; with 2 000 recall exceeds 0.99
    assert sum(toxic) / len(toxic) > 0.7 and sum(clean) / len(clean) < 0.01
