import json

import pytest
from pyspark.sql import functions as F

from millrace.operators.sql import run_batch, run_sql
from millrace.sources import readers, writers


def test_csv_falls_back_to_latin1(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,n\ncafé,1\nthé,2\n".encode("latin-1"))
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert sorted((r["name"], r["n"]) for r in df.collect()) == [("café", 1), ("thé", 2)]


def test_csv_utf8(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,n\ncafé,1\n", encoding="utf-8")
    assert readers.read_csv(spark, str(tmp_path / "a.csv")).first()["name"] == "café"


def test_json_list_and_object_flatten(spark, tmp_path):
    rows = [{"id": 1, "a": {"b": {"c": 5}}, "tags": ["x", "y"]}, {"id": 2, "a": {"b": {"c": 6}}, "tags": []}]
    (tmp_path / "l.json").write_text(json.dumps(rows))
    df = readers.read_json_flat(spark, str(tmp_path / "l.json"))
    got = {r["id"]: (r["a.b.c"], r["tags"]) for r in df.collect()}
    assert got == {1: (5, '["x","y"]'), 2: (6, "[]")}
    (tmp_path / "o.json").write_text(json.dumps(rows[0]))
    assert readers.read_json_flat(spark, str(tmp_path / "o.json")).count() == 1


def test_write_modes(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(5)
    writers.write_table(df, path)
    writers.append_rows(df, path)
    assert spark.read.parquet(path).count() == 10
    writers.write_table(df, path)
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(ValueError):
        writers.write_table(df, path, "upsert")


@pytest.mark.parametrize("fmt", writers.FORMATS)
def test_export_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a,b", [1, 2]), (2, None, [])], "i int, s string, l array<int>")
    writers.export(df, str(tmp_path / fmt), fmt)
    back = getattr(spark.read.option("header", True), fmt)(str(tmp_path / fmt))
    assert back.count() == 2 and set(back.columns) == {"i", "s", "l"}


def test_transfer_maps_files_to_tables(spark, tmp_path):
    writers.export(spark.range(3).withColumn("x", F.lit("q")), str(tmp_path / "a.csv"), "csv")
    writers.export(spark.range(4), str(tmp_path / "b.jsonl"), "json")
    writers.transfer(spark, {str(tmp_path / "a.csv"): str(tmp_path / "ta"), str(tmp_path / "b.jsonl"): str(tmp_path / "tb")})
    assert spark.read.parquet(str(tmp_path / "ta")).count() == 3
    assert spark.read.parquet(str(tmp_path / "tb")).count() == 4


def test_parameters_are_values_not_text(spark):
    df = spark.createDataFrame([("a' OR '1'='1",), ("b",)], "s string")
    got = run_sql(spark, {"t": df}, "SELECT s FROM t WHERE s = :p", {"p": "a' OR '1'='1"}, {"p": "string"})
    assert got.count() == 1


def test_batch_returns_last_rows(spark):
    df = run_batch(spark, {"t": spark.range(3)}, ["CREATE OR REPLACE TEMPORARY VIEW u AS SELECT id + 1 AS k FROM t", "SELECT sum(k) AS s FROM u"])
    assert df.first()["s"] == 6
