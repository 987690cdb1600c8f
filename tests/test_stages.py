"""End-to-end: scout -> evaluate -> compile -> deploy -> optimize -> dashboard."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from pagefleet.operators import ledger as L
from pagefleet.operators import verdicts as V
from pagefleet.plans import stages as ST
from pagefleet.sinks.containers import read_document
from pagefleet.sources import payloads as PL
from pagefleet.sources.files import read_ledger

from tests.test_routes import COMPLIANCE


def test_five_stages(spark, tmp_dir):
    ledger = f"{tmp_dir}/ledger"
    os.makedirs(f"{tmp_dir}/manifest")
    cands = [
        {"niche_id": "b2b_chemical_compliance", "target_dataset_url": "https://example.gov/c.csv",
         "primary_keywords": ["compliance"], "estimated_monthly_volume": 45000, "average_cpc": 14.5,
         "keyword_difficulty": 12, "data_sources_available": ["a", "b", "c"], "monetization_vector": "LEAD_GEN",
         "estimated_lead_value": 175.0, "uniqueness_potential_ratio": 0.82},
        {"niche_id": "too_hard", "target_dataset_url": "x", "keyword_difficulty": 80,
         "uniqueness_potential_ratio": 0.9},
    ]
    with open(f"{tmp_dir}/manifest/m.json", "w") as fh:
        json.dump({"candidates": cands}, fh)
    ST.register_candidate_source(
        "manifest", lambda s, seed: PL.read_manifest(s, f"{tmp_dir}/manifest").filter(F.col("error").isNull())
        .select(F.col("pos").cast("long").alias("pos"), "candidate"))

    def broken(s, seed):
        raise RuntimeError("portal down")

    ST.register_candidate_source("portal", broken)
    scout = ST.run_scout(spark, ["manifest", "portal"], "", ledger, "run-1")
    assert scout["report"].first().accepted == 1
    refl = {r.source_id: r.ok for r in scout["reflections"].collect()}
    assert refl == {"manifest": True, "portal": False}
    opp = read_ledger(spark, ledger, "arbitrage_opportunities").first()
    assert opp.arbitrage_score == 285468.75 and opp.status == "pending"

    answer = {"monetization_pattern": "local_lead_generation", "architectural_layout": "directory",
              "confidence": 0.81, "seo_keyword_layout": {"route_pattern": "/{city}/{category}",
                                                         "high_volume_columns": ["city", "category"],
                                                         "sample_routes": ["/austin/chemical"]}}
    bodies = read_ledger(spark, ledger, "arbitrage_opportunities").select(
        V.request_id("evaluate", F.col("id")).alias("request_id"),
        F.lit(json.dumps({"jsonrpc": "2.0", "result": answer})).alias("body"))
    ev = ST.run_evaluate(spark, ledger, bodies)
    assert ev["report"].first().approved == 1
    eval_id = read_ledger(spark, ledger, "evaluations").first().id

    data = spark.createDataFrame(COMPLIANCE, "company string, city string, category string, violations long, "
                                             "penalty_usd long").withColumn("pos", F.monotonically_increasing_id())
    comp = ST.run_compile(spark, ledger, eval_id, data, f"{tmp_dir}/site", order_by=["pos"])
    assert comp["status"].first().status == "COMPLETED"
    assert comp["routes"].count() == 4
    rep = comp["report"].first()
    assert (rep.row_count, rep.route_count, rep.niche_id) == (8, 4, "b2b_chemical_compliance")
    sitemap = spark.read.text(f"{tmp_dir}/site/sitemap/data").count()
    assert sitemap == 2 + 1 + 4 + 1
    index = [r.value for r in spark.read.text(f"{tmp_dir}/site/index/data").collect()]
    assert sum(1 for line in index if line.startswith("<a href=")) == 4

    dep = ST.run_deploy_records(spark, ledger)
    plan = dep["plan"].first()
    assert plan.outcome == "COMPLETED" and plan.live_url == "https://b2b-chemical-compliance.pages.dev"

    dep_row = read_ledger(spark, ledger, "deployments").first()
    assert dep_row.cloudflare_deployment_id.startswith("dryrun-")
    dep_id = dep_row.id
    site_id = read_ledger(spark, ledger, "site_generations").first().id
    metrics = spark.createDataFrame([(dep_id, "/", 1010, 5, 0, 0), (dep_id, "/directory", 240, 18, 4200, 1)],
                                    "deployment_id long, page_path string, impressions long, clicks long, "
                                    "revenue_cents long, pos long")
    bodies = metrics.where("page_path = '/'").select(
        ST.page_request(F.col("deployment_id"), F.col("page_path"), F.col("pos")).alias("request_id"),
        F.lit(json.dumps({"result": {"title": "Better", "description": "", "keywords": ["a"]}})).alias("body"))
    meta = spark.createDataFrame([(site_id, "Old", "d")], "site_id long, title string, description string")
    ST.register_telemetry_source("landed", lambda s, deps: metrics.join(
        deps.select(F.col("id").alias("deployment_id")), "deployment_id", "left_semi"))
    opt = ST.run_optimize(spark, ledger, "landed", bodies, meta)
    r = opt["report"].first()
    assert (r.pages_ingested, r.flagged, r.reinforced) == (2, 1, 1)
    assert opt["meta"].first().title == "Better"

    dash = ST.fleet_dashboard(spark, ledger)
    counts = {r.table: r.rows for r in dash["counts"].collect()}
    assert counts["opportunities"] == 1 and counts["deployments"] == 1 and counts["optimizations"] == 1
    rev = dash["revenue"].first()
    assert (rev.impressions, rev.clicks, rev.revenue_usd) == (1250, 23, 42.0)


@pytest.mark.parametrize("order_by", [["penalty_usd", "company"], ["company"], ["violations", "penalty_usd", "company"], []])
def test_route_pages_for_any_order(spark, tmp_dir, order_by):
    ledger, names = f"{tmp_dir}/ledger", ["company", "city", "category", "violations", "penalty_usd"]
    L.append_ledger(spark.createDataFrame(
        [(1, 2, "directory", ["city", "category"], "approved", 0.8)],
        "id long, opportunity_id long, template_type string, seo_high_volume_columns array<string>, verdict string, "
        "confidence double").withColumn("updated_at", F.current_timestamp()), ledger, "evaluations")
    L.append_ledger(spark.createDataFrame([(2, "niche")], "id long, niche_id string").withColumn(
        "updated_at", F.current_timestamp()), ledger, "arbitrage_opportunities")
    data = spark.createDataFrame(COMPLIANCE, "company string, city string, category string, violations long, penalty_usd long")
    comp = ST.run_compile(spark, ledger, 1, data, f"{tmp_dir}/site", order_by=order_by)
    want: dict = {}
    for row in sorted(COMPLIANCE, key=lambda r: [r[names.index(c)] for c in order_by]):
        want.setdefault(row[1:3], []).append(row[0])
    routes = {r.path: (r.params["city"], r.params["category"]) for r in comp["routes"].collect()}
    got = {}
    for path in routes:
        lines = read_document(spark, f"{tmp_dir}/site/pages", site="site", path=path).decode().splitlines()
        assert lines[0] == "<!doctype html>" and lines[-1] == "</tbody></table></body></html>"
        rows = [x.split("</td>")[0].removeprefix("<tr><td>") for x in lines if x.startswith("<tr>")]
        got[routes[path]] = rows if order_by else sorted(rows)
    assert got == {k: v if order_by else sorted(v) for k, v in want.items() if k in routes.values()} and len(got) == len(routes)
