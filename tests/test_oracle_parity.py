"""Every registered query with an oracle equals DuckDB on the smallest tables."""

import pytest

from querylens import registry
from querylens.checks.oracle import compare

from .conftest import SMALL

registry.load_all()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_oracle(spark, duck, name):
    info = compare(spark, duck, name, registry.QUERIES[name], registry.ORACLES[name], SMALL)
    assert info["schema_ok"], info
    assert info["rows_ok"], info
    assert info["values_ok"], info


def test_entry_runs(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"db_id", "n", "fast", "slow", "pct_slow", "slow_rate", "degenerate"}
    assert set(e.oracle_sql()) <= set(e.queries())
