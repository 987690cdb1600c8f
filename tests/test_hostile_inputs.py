"""Inputs that used to be cut, altered or fatal."""

from __future__ import annotations

import json
import os
import random

from pyspark.sql import functions as F

from pagefleet.operators import routes as R
from pagefleet.operators import telemetry as TM
from pagefleet.operators import verdicts as V
from pagefleet.sources import files, payloads


def test_paths_are_unique_per_site(spark):
    rng = random.Random(3)
    stems = ["/a", "/a-2", "/a-2-2", "/b", "/a-3"]
    rows = [(i, rng.choice(stems), rng.choice(["x", "y", None]), 1000 - i) for i in range(200)]
    rows += [(1000 + i, "/hot", "x", 2000 - i) for i in range(100)]  # a family of a third of all routes
    df = spark.createDataFrame(rows, "id long, p string, site string, rank long")
    got = {r.id: r.path for r in R.disambiguate_paths(df, "p", ["rank"], [True], scope=["site"]).collect()}
    taken: dict = {}
    want = {}
    for i, p, site, _ in sorted(rows, key=lambda r: r[3]):
        names, path, n = taken.setdefault(site, set()), p, 2
        while path in names:
            path, n = f"{p}-{n}", n + 1
        names.add(path)
        want[i] = path
    assert got == want


def test_no_route_columns_no_members(spark):
    df = spark.createDataFrame([("a", 1)], "city string, n long")
    assert R.route_rows(df, R.build_routes(df, ["nope"], "X"), ["nope"]).count() == 0


def test_json_files_by_their_own_form(spark, tmp_dir):
    path = os.path.join(tmp_dir, "mixed.json")
    os.makedirs(path)
    forms = {"a": json.dumps([{"a": i} for i in range(50)]), "b": '\n{"a":1}\n{"a":2}\n', "c": json.dumps({"a": 7}, indent=1)}
    for name, body in forms.items():
        with open(f"{path}/{name}.json", "w") as f:
            f.write(body)
    rows = files.open_dataset(spark, path)
    assert rows.columns == ["a"] and rows.count() == 53


def test_bad_counts_and_error_payloads(spark):
    group = '{"count":"NaN","sum":{"visits":1e30}}'
    raw = spark.createDataFrame([
        ('{"errors":[{"message":"bad"}]}',), ("oops",),
        ('{"data":{"viewer":{"accounts":[{"rumPageloadEventsAdaptiveGroups":[%s]}]}}}' % group,)], "value string")
    assert [(r.impressions, r.clicks) for r in payloads.parse_rum_groups(raw).collect()] == [(0, 0)]
    assert sorted(r.error for r in payloads.parse_rum_errors(raw).collect()) == ["bad", "payload is not JSON"]


def test_verdict_defaults_and_repeated_answers(spark):
    base = {"monetization_pattern": "premium_cpc", "architectural_layout": "directory"}
    bodies = [("r1", base), ("r2", base | {"confidence": 0.9}), ("r2", base | {"confidence": 0.9}),
              ("r3", base | {"confidence": 0.9, "seo_keyword_layout": "text"})]
    answers = spark.createDataFrame([(k, json.dumps(b)) for k, b in bodies], "request_id string, j string").select(
        "request_id", F.lit(True).alias("ok"), F.parse_json("j").alias("result"), F.lit(None).cast("string").alias("error"))
    asked = spark.createDataFrame([("r1",), ("r2",), ("r3",), ("r4",)], "request_id string")
    got = {r.request_id: r.status for r in V.apply_verdicts(asked, answers).collect()}
    assert got == {"r1": "REJECTED", "r2": "APPROVED", "r3": "FAILED", "r4": "FAILED"}


def test_two_deployments_of_one_site(spark):
    capped = spark.createDataFrame([(1, "/a", 9, 0), (2, "/a", 9, 0)], "deployment_id long, page_path string, site_id long, seq long")
    answers = spark.createDataFrame(
        [(1, "/a", 9, True, "it's", None), (2, "/a", 9, False, None, "timed out")],
        "deployment_id long, page_path string, site_id long, ok boolean, title string, error string")
    meta = spark.createDataFrame([(9, "t", "d")], "site_id long, title string, description string")
    got = TM.optimization_outcomes(capped, answers, meta, key=["deployment_id", "page_path"]).collect()
    assert sorted((r.deployment_id, r.status, r.detail) for r in got) == [
        (1, "COMPLETED", 'title="it\'s"'), (2, "FAILED", "timed out")]
