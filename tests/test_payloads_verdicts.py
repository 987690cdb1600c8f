"""Landed payload parsers and agent answers."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from pagefleet.operators import verdicts as V
from pagefleet.sources import payloads as PL


def _write(path, text):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_manifest_shapes(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/m")
    _write(f"{tmp_dir}/m/obj.json", json.dumps({"candidates": [{"niche_id": "osha_a"}, 3, {"niche_id": "x",
                                                                                            "source": "own"}]}))
    _write(f"{tmp_dir}/m/arr.json", json.dumps([{"niche_id": "osha_b", "primary_keywords": ["k"]}]))
    _write(f"{tmp_dir}/m/bad.json", "{not json")
    out = PL.read_manifest(spark, f"{tmp_dir}/m")
    good = out.filter(F.col("error").isNull()).select(
        F.try_variant_get("candidate", "$.niche_id", "string").alias("n"),
        F.try_variant_get("candidate", "$.source", "string").alias("s")).collect()
    assert sorted((r.n, r.s) for r in good) == [("osha_a", "manifest"), ("osha_b", "manifest"), ("x", "own")]
    assert out.filter(F.col("error").isNotNull()).count() == 1


def test_ckan_packages(spark):
    payload = {"success": True, "result": {"results": [
        {"name": "osha-logs", "tags": [{"name": "osha"}, {"name": ""}],
         "resources": [{"format": "PDF", "url": "https://x/a.pdf"}, {"format": "CSV", "url": "https://x/a.csv"}]},
        {"name": "", "id": "pkg-2", "resources": []},
        {"name": "", "id": "", "resources": [{"format": "HTML", "url": "https://x/b.html"}]},
    ]}}
    raw = spark.createDataFrame([(json.dumps(payload),), (json.dumps({"success": False}),)], "value string")
    cands, errors = PL.parse_ckan_packages(raw)
    rows = {r.niche_id: r for r in cands.collect()}
    assert set(rows) == {"osha-logs", "unknown-dataset"}
    assert rows["osha-logs"].target_dataset_url == "https://x/a.csv"
    assert rows["osha-logs"].data_sources_available == ["csv", "pdf"]
    assert rows["osha-logs"].primary_keywords == ["osha"]
    assert errors.count() == 1


def test_keyword_overview_shapes(spark):
    rows = [{"keyword": "a", "volume": 45000, "cpc": 1450, "difficulty": 12}, "junk"]
    raw = spark.createDataFrame(
        [("k1", json.dumps({"metrics": rows})), ("k2", json.dumps(rows)), ("k3", json.dumps({"other": 1}))],
        "key string, value string")
    out = PL.parse_keyword_overview(raw)
    assert sorted(r.key for r in out.collect()) == ["k1", "k2"]


def test_rum_groups(spark):
    body = {"data": {"viewer": {"accounts": [{"rumPageloadEventsAdaptiveGroups": [
        {"count": 900, "sum": {"visits": 6}, "dimensions": {"requestPath": "/"}},
        {"count": 120, "sum": {"visits": 30}, "dimensions": {"requestPath": "/x"}},
        {"count": None, "dimensions": {}},
        {"count": 5, "sum": {"visits": 1}, "dimensions": {"requestPath": "/x"}},
    ]}]}}}
    out = PL.parse_rum_groups(spark.createDataFrame([(json.dumps(body),)], "value string")).orderBy("group_pos")
    got = [(r.page_path, r.impressions, r.clicks) for r in out.collect()]
    assert got == [("/", 900, 6), ("/x", 120, 30), ("/", 0, 0), ("/x", 5, 1)]


def test_unwrap_responses(spark):
    bodies = [
        ("ok", json.dumps({"jsonrpc": "2.0", "result": {"a": 1}})),
        ("missing", json.dumps({"jsonrpc": "2.0"})),
        ("err", json.dumps({"error": {"code": 1}})),
        ("falsy_err", json.dumps({"error": None, "result": {}})),
        ("bad_result", json.dumps({"result": [1]})),
        ("not_obj", json.dumps([1])),
        ("invalid", "{"),
    ]
    out = {r.k: (r.ok, r.error) for r in V.unwrap_agent_responses(
        spark.createDataFrame(bodies, "k string, body string")).collect()}
    assert out["ok"][0] and out["missing"][0] and out["falsy_err"][0]
    assert not out["err"][0] and "JSON-RPC error" in out["err"][1]
    assert not out["bad_result"][0] and not out["not_obj"][0] and not out["invalid"][0]


def test_apply_verdicts(spark):
    good = {"monetization_pattern": "local_lead_generation", "architectural_layout": "directory",
            "confidence": 0.81, "seo_keyword_layout": {"route_pattern": "/{city}", "high_volume_columns": ["city"],
                                                       "sample_routes": []}}
    low = dict(good, confidence=0.2)
    bad = dict(good, monetization_pattern="nope")
    opps = spark.createDataFrame([(1, "r1"), (2, "r2"), (3, "r3"), (4, "r4")], "id long, request_id string")
    ans = spark.createDataFrame([("r1", json.dumps({"result": good})), ("r2", json.dumps({"result": low})),
                                 ("r3", json.dumps({"result": bad}))], "request_id string, body string")
    out = {r.id: r for r in V.apply_verdicts(opps, V.unwrap_agent_responses(ans)).collect()}
    assert out[1].status == "APPROVED" and out[2].status == "REJECTED"
    assert out[3].status == "FAILED" and "monetization_pattern" in out[3].error
    assert out[4].status == "FAILED" and "no answer" in out[4].error


def test_default_answers(spark, tmp_dir):
    _write(f"{tmp_dir}/evaluate.json", json.dumps({"confidence": 0.9}))
    ok = V.default_answers(spark, f"{tmp_dir}/evaluate.json", "evaluate").first()
    assert ok.ok
    missing = V.default_answers(spark, f"{tmp_dir}/nope.json", "evaluate").first()
    assert not missing.ok and "no answer fixture" in missing.error


def test_request_ids_are_deterministic(spark):
    df = spark.createDataFrame([(1,), (2,)], "k long")
    a = [r.request_id for r in V.agent_requests(df, "t", F.struct("k"), "k").collect()]
    b = [r.request_id for r in V.agent_requests(df, "t", F.struct("k"), "k").collect()]
    assert a == b and len(set(a)) == 2 and all(len(x) == 32 for x in a)


def test_keyword_difficulty_falls_through_only_when_falsy(spark):
    from pagefleet.operators import scoring as S

    rows = [{"keyword": "k", "volume": 10, "cpc": 100, "difficulty": d, "keyword_difficulty": 7}
            for d in (0, "0", None, "", "abc", 5)]
    raw = spark.createDataFrame([(i, json.dumps([r])) for i, r in enumerate(rows)], "key long, value string")
    best = S.representative_keyword(PL.parse_keyword_overview(raw).withColumnRenamed("key", "niche_id"))
    got = {r.niche_id: r.keyword_difficulty for r in best.collect()}
    # 0, None and "" are falsy -> 7; "0" and "abc" are truthy strings -> their number (0)
    assert got == {0: 7, 1: 0, 2: 7, 3: 7, 4: 0, 5: 5}


def test_keyword_overview_lists(spark):
    """Every payload keeps its rows as a list: places count entries that are no objects, falsy difficulties are marked."""
    difficulties = [0, "0", None, "", "abc", 5, False, 0.0, -0.0, [], {}, True, [1], {"a": 1}, 0.5, "0.0"]
    rows = [{"keyword": f"k{n}", "volume": "12", "cpc": 1.5, "difficulty": d} for n, d in enumerate(difficulties)]
    texts = {"bare": json.dumps([1, None, *rows, "junk"]), "data": json.dumps({"keywords": 1, "data": [{"volume": [1]}]}),
             "none": json.dumps({"keywords": {}}), "broken": "{", "empty": "[]", "null": None}
    raw = spark.createDataFrame(list(texts.items()), "key string, value string")
    lists = {r["key"]: r["items"] for r in PL.keyword_overview_lists(raw).collect()}
    assert set(lists) == set(texts) and not any(lists[k] for k in ("none", "broken", "empty", "null"))
    assert [(r.pos, r.keyword) for r in lists["bare"]] == [(n + 2, f"k{n}") for n in range(len(rows))]
    assert [r.difficulty_truthy for r in lists["bare"]] == [bool(d) for d in difficulties]
    assert (lists["bare"][0].volume, lists["bare"][0].cpc, lists["bare"][1].difficulty) == ("12", "1.5", "0")
    assert [(r.pos, r.keyword, r.difficulty_truthy) for r in lists["data"]] == [(0, None, False)]
    flat = sorted((r["key"], r["pos"]) for r in PL.parse_keyword_overview(raw).collect())
    assert flat == sorted((k, r.pos) for k, rs in lists.items() for r in rs or [])


def test_overview_parse_shuffles_no_words(spark, tmp_dir):
    from pagefleet.plans import agent_queries as Q

    texts = [(1, "one three three"), (2, "a bb " * 700 + "longest"), (3, None), (4, " "), (None, "x yy")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_dir}/documents.parquet")
    best = Q.overview_parse(spark, tmp_dir)
    assert sorted((str(r.doc_id), r.keyword, r.estimated_monthly_volume, r.keyword_difficulty) for r in best.collect()) == [
        ("1", "three", 5, 1), ("2", "longest", 7, 3), ("None", "yy", 2, 2)]
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "array_max" in plan[plan.rindex("Sort"):]
