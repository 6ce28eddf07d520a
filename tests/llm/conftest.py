import pytest

#: names that operators use inside
CLASHING = ["h1", "h2", "t", "z", "v", "node", "keys", "spans", "rate", "score", "ids", "_t", "_text", "_score", "posterior", "rep", "g"]


@pytest.fixture
def table(spark):
    """Rows as a DataFrame with extra columns of clashing names."""
    def make(rows, schema, extra=True):
        df = spark.createDataFrame(rows, schema)
        if extra:
            from pyspark.sql import functions as F
            df = df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in df.columns])
        return df
    return make


@pytest.fixture(scope="session")
def vocabulary():
    from querylens.llm.queries import vocabulary
    return vocabulary()
