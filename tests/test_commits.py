"""The commit log, keys and the stage runner."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagefleet.operators import ledger as L
from pagefleet.operators.commits import LedgerRun, manifests, run_stage
from pagefleet.plans import stages as ST
from pagefleet.sources.files import read_ledger


def jobs(spark, *ids):
    return spark.createDataFrame([(i, "k") for i in ids], "id string, kind string")


def ids(spark, root, table="jobs"):
    return sorted(r.id for r in read_ledger(spark, root, table).collect())


def test_a_run_counts_once(spark, tmp_dir):
    first = LedgerRun(spark, tmp_dir, "r")
    first.append(jobs(spark, "a", "b"), "jobs")
    assert ids(spark, tmp_dir) == []  # nothing before the commit
    again = LedgerRun(spark, tmp_dir, "r")  # the first try seemed lost
    again.append(jobs(spark, "a", "b"), "jobs")
    again.append(jobs(spark, "c"), "jobs")
    assert again.commit() and ids(spark, tmp_dir) == ["a", "b", "c"]
    assert not first.commit() and ids(spark, tmp_dir) == ["a", "b", "c"]  # it wasn't lost, but late
    assert [r.attempt for r in manifests(spark, tmp_dir).collect()] == [again.attempt]


def test_all_tables_of_a_run_appear_together(spark, tmp_dir):
    run = LedgerRun(spark, tmp_dir, "r")
    run.append(jobs(spark, "a"), "jobs")
    run.append(spark.createDataFrame([(1, 2)], "id long, deployment_id long"), "analytics_logs")
    assert ids(spark, tmp_dir) == [] == ids(spark, tmp_dir, "analytics_logs")
    run.commit()
    assert ids(spark, tmp_dir) == ["a"] and ids(spark, tmp_dir, "analytics_logs") == [1]


@pytest.mark.parametrize("names", [("a/b", "a_2Fb", "a%2Fb"), ("", "x y", "é=1"), ("1", "01", "1.0")])
def test_run_ids_of_any_text_stay_apart(spark, tmp_dir, names):
    for n in names:
        L.append_ledger(jobs(spark, n or "none"), tmp_dir, "jobs", run := LedgerRun(spark, tmp_dir, n))
        assert run.commit()
    assert ids(spark, tmp_dir) == sorted(n or "none" for n in names)


def test_key_clashes_are_found(spark):
    rows = L.assign_keys(spark.range(1000), "run", ["id"])
    assert L.audit_keys(rows).count() == 0 and L.checked_keys(rows).columns == ["id"]
    with pytest.raises(L.KeyCollision):
        L.checked_keys(rows.withColumn("id", F.lit(1).cast("long")))
    halves = spark.range(1).select(*L.key_halves("a", F.lit("b")), *L.key_halves("ab", F.lit(""))).first()
    assert len(set(halves)) == 4


def test_a_failed_stage_is_a_row_and_can_be_tried_again(spark, tmp_dir):
    key = L.key_id("job", F.lit("r"))

    def broken():
        raise ValueError("no portal")

    out = run_stage(spark, tmp_dir, "scout", "r", broken, key, {"seed_niche": F.lit("s")})
    assert tuple(out["status"].first()) == ("AGENT_ACTION_REQUIRED", "ValueError", "no portal")
    (row,) = read_ledger(spark, tmp_dir, "scout_jobs").collect()
    assert row.status == "failed" and "no portal" in row.log_trace and row.seed_niche == "s" and row.created_at

    def works():
        run = LedgerRun(spark, tmp_dir, "r")
        run.append(spark.range(1).select(key.alias("id"), F.lit("completed").alias("status"),
                                         (F.current_timestamp() + F.expr("INTERVAL 1 SECOND")).alias("updated_at")), "scout_jobs")
        run.commit()
        return {}

    run_stage(spark, tmp_dir, "scout", "r", works, key)
    (now,) = L.latest_state(read_ledger(spark, tmp_dir, "scout_jobs"), "id", ["updated_at"]).collect()
    assert now.status == "completed"


def test_an_unknown_generation_is_told(spark, tmp_dir):
    out = ST.run_deploy_records(spark, tmp_dir, site_generation_id=7)
    assert tuple(out["status"].first()) == ("AGENT_ACTION_REQUIRED", "SiteGenerationNotFound", "site generation 7 not found")


def test_a_seed_filters_the_manifest_only(spark, tmp_dir):
    import json
    import os

    os.makedirs(f"{tmp_dir}/m")
    with open(f"{tmp_dir}/m/a.json", "w") as fh:
        json.dump([{"niche_id": "solar_leads", "primary_keywords": ["roof"]}, {"niche_id": "x", "primary_keywords": ["Solar"]},
                   {"niche_id": "y"}], fh)
    ST.register_candidate_source("manifest", ST.manifest_source(f"{tmp_dir}/m"))
    ST.register_candidate_source("portal", lambda s, seed: s.createDataFrame([(0, '{"niche_id": "other"}')], "pos long, j string").select(
        "pos", F.parse_json("j").alias("candidate")))
    out = ST.run_scout(spark, ["manifest", "portal"], "solar", f"{tmp_dir}/ledger", "r")
    assert {r.source_id: r.candidate_count for r in out["reflections"].collect()} == {"manifest": 2, "portal": 1}
