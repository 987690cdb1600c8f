"""Column functions: slugs, titles, coercion, math."""

from __future__ import annotations

import json
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from pagefleet.functions import scalar, text


def _one(spark, col, value, ddl="s string"):
    return spark.createDataFrame([(value,)], ddl).select(col.alias("o")).first().o


def test_route_slug(spark):
    assert _one(spark, text.route_slug("s"), "Austin, TX!") == "austin-tx"
    assert _one(spark, text.route_slug("s"), "  Solar / Wind  ") == "solar-wind"
    assert _one(spark, text.route_slug("s"), "!!!") == ""


def test_site_and_project_slug(spark):
    assert _one(spark, text.site_slug("s"), "***") == "site"
    long = "x" * 57 + "-yz"
    assert _one(spark, text.project_slug("s"), long) == "x" * 57
    assert _one(spark, text.project_slug("s", fallback="fallback"), "") == "fallback"


def test_title_case_like_python(spark):
    for raw in ["b2b_industrial_chemical_compliance", "osha-logs", "hello world", "ÉCOLE_data"]:
        expected = raw.replace("_", " ").replace("-", " ").title()
        assert _one(spark, text.title_from("s"), raw) == expected
    assert _one(spark, text.title_from("s"), "") == "Data Site"


def test_extract_pages_url(spark):
    log = "Uploading...\n✨ Deployment complete! https://abc-123.my-site.pages.dev done"
    assert _one(spark, text.extract_pages_url("s"), log) == "https://abc-123.my-site.pages.dev"
    assert _one(spark, text.extract_pages_url("s"), "nothing") == ""


def test_project_base(spark):
    df = spark.createDataFrame([(None, "/b/my-niche-e3-s9", 9), ("Cool Niche", None, 1), (None, None, 4)],
                               "n string, b string, i long")
    out = [r.o for r in df.select(text.project_base("n", "b", "i").alias("o")).collect()]
    assert out == ["my-niche", "cool-niche", "site-4"]


def test_ctr(spark):
    df = spark.createDataFrame([(5, 1000), (0, 0)], "c long, i long")
    assert [r.o for r in df.select(scalar.ctr("c", "i").alias("o")).collect()] == [0.005, 0.0]


def test_json_safe(spark):
    df = spark.createDataFrame(
        [(float("nan"), float("inf"), 1.5, date(2026, 1, 2), datetime(2026, 1, 2, 3, 4, 5), Decimal("3.50"),
          Decimal("4.00"))],
        "a double, b double, c double, d date, t timestamp_ntz, n decimal(10,2), x decimal(10,2)")
    row = scalar.json_safe_frame(df).first()
    assert row.a is None and row.b is None and row.c == 1.5
    assert row.d == "2026-01-02" and row.t == "2026-01-02T03:04:05"
    assert row.n.toJson() == "3.5" and row.x.toJson() == "4"  # JSON numbers
    doc = scalar.json_safe_frame(df).select(scalar.strict_json(F.struct("a", "c")).alias("j")).first().j
    assert json.loads(doc) == {"a": None, "c": 1.5}


def test_calculator_value(spark):
    df = spark.createDataFrame([("2", 3.0, None), ("x", float("nan"), 1.0)], "a string, b double, c double")
    out = [r.v for r in df.select(scalar.calculator_value(df, [("a", 1), ("b", 2), ("c", 1)]).alias("v")).collect()]
    assert out == [8.0, 1.0]


def test_json_list_codec(spark):
    assert _one(spark, scalar.json_list_decode("s"), '["a", "b"]') == ["a", "b"]
    assert _one(spark, scalar.json_list_decode("s"), None) == []


def test_json_text_follows_the_schema(spark):
    from decimal import Decimal

    df = spark.createDataFrame(
        [(Decimal("12345678901234567890.1200"), [float("nan"), 1.5, None], {"a": Decimal("7.0000")}, (float("inf"), [(Decimal("-0.0100"),)])),
         (Decimal("5.0000"), None, {}, None)],
        "d decimal(38,4), xs array<double>, m map<string, decimal(10,4)>, s struct<x: double, ys: array<struct<z: decimal(8,4)>>>")
    got = [r[0] for r in df.select(scalar.json_text(df)).collect()]
    assert got == ['{"d":12345678901234567890.12,"xs":[null,1.5,null],"m":{"a":7},"s":{"x":null,"ys":[{"z":-0.01}]}}',
                   '{"d":5,"xs":null,"m":{},"s":null}']
