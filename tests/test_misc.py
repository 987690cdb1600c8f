"""Remaining small operators: site meta reader, writers, caps, build names."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F

from pagefleet.functions import text
from pagefleet.operators import routes as R
from pagefleet.sinks import writers as W
from pagefleet.sources import payloads as PL


def test_read_site_meta(spark, tmp_dir):
    with open(f"{tmp_dir}/a.json", "w") as fh:
        json.dump({"title": "T"}, fh)
    with open(f"{tmp_dir}/b.json", "w") as fh:
        fh.write("{broken")
    out = {r.site_path.rsplit("/", 1)[-1]: r.t for r in PL.read_site_meta(spark, tmp_dir).select(
        "site_path", F.to_json("meta").alias("t")).collect()}
    assert json.loads(out["a.json"]) == {"title": "T"} and out["b.json"] == "{}"


def test_build_name(spark):
    df = spark.createDataFrame([("Cool Niche!", 3, 9), (None, 4, 1)], "n string, e long, s long")
    assert [r.o for r in df.select(text.build_name("n", "e", "s").alias("o")).collect()] == [
        "cool-niche-e3-s9", "evaluation-4-e4-s1"]


def test_cap_rows(spark):
    df = spark.range(10)
    assert [r.id for r in R.cap_rows(df, 3, ["id"]).collect()] == [0, 1, 2]
    assert R.cap_rows(df, -1, ["id"]).count() == 0


def test_writers_strict_json(spark, tmp_dir):
    df = spark.createDataFrame([(1, float("nan"))], "a long, b double")
    W.write_rows(df, f"{tmp_dir}/rows")
    text_rows = [r.value for r in spark.read.text(f"{tmp_dir}/rows").collect()]
    assert text_rows == ['{"a":1,"b":null}']
    meta = spark.createDataFrame([("s1", 1)], "site string, x long").select("site", F.struct("x").alias("meta"))
    W.write_meta(meta, f"{tmp_dir}/meta")
    assert spark.read.text(f"{tmp_dir}/meta/data").first().value == '{"x":1}'


def test_documents_lie_in_order_in_few_files(spark, tmp_dir):
    from pyspark.sql import functions as F

    from pagefleet.sinks.containers import document_index, read_document, write_documents

    df = spark.range(3000).select(  # a third of all lines in one document, 200 small ones of two sites
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("d"), F.col("id") % 200)).alias("path"),
        F.when(F.col("id") % 2 == 0, F.lit("a")).otherwise(F.lit(None)).alias("site"), F.col("id").alias("seq"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("é line "), F.col("id"))).alias("line")).repartition(5)
    write_documents(df, f"{tmp_dir}/docs", ["site", "path"], ["seq"], partitions=6)
    want: dict = {}
    for r in sorted(df.collect(), key=lambda r: r.seq):
        want[r.site, r.path] = want.get((r.site, r.path), b"") + (r.line or "").encode() + b"\n"
    index = document_index(spark, f"{tmp_dir}/docs")
    assert {(r.site, r.path): r.length for r in index.groupBy("site", "path").agg(F.sum("length").alias("length")).collect()} \
        == {k: len(v) for k, v in want.items()}
    assert index.where("path = 'hot'").select("container").distinct().count() > 2
    assert len(list(Path(f"{tmp_dir}/docs/data").glob("part-*"))) <= 6 < len(want)
    for site, path in [("a", "hot"), (None, "hot"), ("a", "d2"), (None, "d1")]:
        assert read_document(spark, f"{tmp_dir}/docs", site=site, path=path) == want[site, path]
    assert read_document(spark, f"{tmp_dir}/docs", site="a", path="none") is None


def test_missing_manifest_is_an_error_row(spark, tmp_dir):
    out = PL.read_manifest(spark, f"{tmp_dir}/nope.json").collect()
    assert len(out) == 1 and out[0].candidate is None and "not found" in out[0].error


def test_profile_file_reports_reader(spark, tmp_dir):
    from pagefleet.sources import files

    with open(f"{tmp_dir}/d.tsv", "w") as fh:
        fh.write("a\tb\n1\tx\n2\ty\n")
    _, stats, _ = files.profile_file(spark, f"{tmp_dir}/d.tsv")
    r = stats.first()
    assert (r.reader, r.row_count, r.column_count) == ("tsv", 2, 2)
