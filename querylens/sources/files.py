"""File sources and sinks of the query log (IO1-IO3, IO7).

* question files: JSON arrays, required ``db_id``/``SQL``, defaults for
  ``question_id`` and ``difficulty``;
* query logs as CSV with quoted multi-line SQL (Parquet preferred); both are
  read by all splits of a file (:mod:`.split_scan`);
* JSON Lines history/feature files (blank lines skipped, missing path ->
  empty frame);
* report sinks: one directory per report.

Writers never gather a table into one task: a JSON-array file is written
per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .split_scan import csv_records, json_objects, parsed_csv

QUERY_LOG_DDL = "question_id long, db_id string, sql string, difficulty string, runtime_s double"


def write_json_arrays(df: DataFrame, path: str, rename: dict[str, str] | None = None) -> None:
    """Write ``df`` as JSON-array text files, one array per partition and one
    object per line; rows are streamed, none are gathered."""
    rename = rename or {}
    obj = F.to_json(F.struct(*[F.col(c).alias(rename.get(c, c)) for c in df.columns]))

    def lines(batches):
        import pyarrow as pa
        mark = "["
        for batch in batches:
            out = []
            for row in batch.column(0).to_pylist():
                out.append(mark + row)
                mark = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == "," else "[]"])], names=["value"])

    df.select(obj.alias("value")).mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """IO1: JSON-array question files -> (question_id, db_id, sql,
    difficulty).  ``db_id`` and ``SQL`` are required; a missing
    ``question_id`` becomes the row's position in its file, from 0, a missing
    difficulty 'unknown'."""
    ensure_checkpoint_dir(spark)
    found = json_objects(spark, path).checkpoint()      # the files are scanned once; two passes read these objects
    names = F.json_object_keys("text")
    # which of the columns occur at all: one row
    there = found.agg(*[F.max(F.array_contains(names, c).cast("int")).alias(c) for c in ("db_id", "SQL")]).first()
    missing = [c for c in ("SQL", "db_id") if not there[c]]
    if missing:
        raise ValueError(f"question file lacks required columns: {missing}")
    row = F.from_json("text", "question_id string, db_id string, SQL string, difficulty string", {"mode": "PERMISSIVE"})
    return found.select("number", row.alias("r")).select(
        F.coalesce(F.col("r.question_id").try_cast("long"), F.col("number")).alias("question_id"), "r.db_id", F.col("r.SQL").alias("sql"),
        F.coalesce("r.difficulty", F.lit("unknown")).alias("difficulty"))


def write_query_log(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """IO2 sink: Parquet, or CSV with a header and quoted multi-line text."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        # explicit null marker: an empty SQL text must stay '' and not turn into null
        w.option("header", True).option("escape", '"').option("quoteAll", True).option("nullValue", "\\N").csv(path)
    else:
        w.parquet(path)


def read_query_log(spark: SparkSession, path: str, fmt: str = "parquet", ddl: str = QUERY_LOG_DDL) -> DataFrame:
    """IO2 source with an explicit schema (no inference)."""
    if fmt == "csv":
        lines = csv_records(spark, path).where("number > 0 and text <> ''")      # record 0 is the header
        return parsed_csv(lines, ddl, {"escape": '"', "nullValue": "\\N"})
    return spark.read.schema(ddl).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """IO3 sink: JSON Lines; non-JSON values (timestamps, decimals) become strings."""
    cols = [F.col(c).cast("string").alias(c) if dict(df.dtypes)[c].startswith(("timestamp", "decimal", "date"))
            else F.col(c) for c in df.columns]
    df.select(*cols).write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, ddl: str | None = None) -> DataFrame:
    """IO3 source: blank lines are skipped by the reader; a missing path
    gives an empty frame with the given schema."""
    r = spark.read.schema(ddl) if ddl else spark.read
    try:
        return r.json(path)
    except Exception as exc:  # missing path
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return spark.createDataFrame([], ddl or "value string")
        raise


def write_report(df: DataFrame, path: str, fmt: str = "csv", sort_by: Sequence[str] = ()) -> None:
    """IO7: one directory per report (CSV with header, or Parquet)."""
    out = df.orderBy(*sort_by) if sort_by else df
    if fmt == "csv":
        out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        out.write.mode("overwrite").parquet(path)
