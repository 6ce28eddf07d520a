"""Files read by many splits against plain readers of the whole text."""

import csv
import io
import json
import os
import random
import tempfile

import pytest

from querylens.sources import files, split_scan


@pytest.fixture
def small_splits(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "331")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def write(name, text):
    folder = tempfile.mkdtemp(prefix="ql-test-")
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


PARTS = ["a", 'say "x"', "{", "}", "[{]", "\\", "\\\"", "line\nfeed", "é日", ",", "", "\r\n", "}\n{", "SELECT '}' FROM t", "x" * 150]


def test_json_arrays(spark, small_splits):
    rnd = random.Random(1)
    pick = lambda: "".join(rnd.choice(PARTS) for _ in range(rnd.randrange(4)))
    objects = [{"db_id": pick(), "SQL": pick(), "nested": {"k": [1, {"z": pick()}]}, **({"question_id": i + 100} if i % 3 else {}),
                **({"difficulty": pick()} if i % 4 else {})} for i in range(80)]
    for indent in (None, 1):
        path = write("q.json", " \n" + json.dumps(objects, indent=indent, ensure_ascii=bool(indent)) + "\n")
        scan = split_scan.json_objects(spark, path)
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 10
        got = {r.number: json.loads(r.text) for r in scan.collect()}
        assert got == dict(enumerate(objects))
        rows = sorted(tuple(r) for r in files.read_questions(spark, path).collect())
        assert rows == sorted((o.get("question_id", i), o["db_id"], o["SQL"], o.get("difficulty", "unknown")) for i, o in enumerate(objects))


def test_empty_and_wrong_json(spark, small_splits):
    assert split_scan.json_objects(spark, write("q.json", "[]")).count() == 0
    with pytest.raises(ValueError, match="required columns"):
        files.read_questions(spark, write("q.json", '[{"db_id": "a"}]'))


def test_csv(spark, small_splits):
    rnd = random.Random(2)
    pick = lambda: "".join(rnd.choice(PARTS) for _ in range(rnd.randrange(4))).replace("\r\n", "\n")
    rows = [[str(i), "db" + str(i % 3), pick(), "simple", str(i / 8)] for i in range(80)]
    out = io.StringIO()
    writer = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n")
    writer.writerows([["question_id", "db_id", "sql", "difficulty", "runtime_s"], *rows])
    path = write("log.csv", out.getvalue())
    assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 10
    got = {r.number: next(csv.reader(io.StringIO(r.text, newline=""))) for r in split_scan.csv_records(spark, path).collect()}
    assert got == dict(enumerate([["question_id", "db_id", "sql", "difficulty", "runtime_s"], *rows]))
    back = sorted(tuple(r) for r in files.read_query_log(spark, path, "csv").collect())
    assert back == sorted((int(a), b, c, d, float(e)) for a, b, c, d, e in rows)


def test_csv_written_by_spark(spark, small_splits):
    rows = [(1, "d", "a\n\"b\"\n,", None, 1.5), (2, None, "", "x", None)]
    df = spark.createDataFrame(rows, files.QUERY_LOG_DDL)
    path = os.path.join(tempfile.mkdtemp(prefix="ql-test-"), "log")
    files.write_query_log(df, path, "csv")
    assert sorted(tuple(r) for r in files.read_query_log(spark, path, "csv").collect()) == rows


def test_questions_are_scanned_once(spark, monkeypatch):
    """The check of the columns and the result read the same found objects, not the files again."""
    path = write("q.json", json.dumps([{"db_id": "d", "SQL": "SELECT 1"}, {"db_id": "e", "SQL": "SELECT 2", "question_id": 9}]))
    found = files.read_questions(spark, path)
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(0, "d", "SELECT 1", "unknown"), (9, "e", "SELECT 2", "unknown")]
