"""Ledger state, telemetry, dashboard, streaming restarts, driver contract."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from pagefleet import schemas
from pagefleet.operators import dashboard as D
from pagefleet.operators import ledger as L
from pagefleet.operators import telemetry as TM
from pagefleet.streaming import flows


def test_evolve_schema_is_additive_and_idempotent(spark):
    old = spark.createDataFrame([(1, "directory")], "id long, template_type string")
    once = L.evolve_schema(old, schemas.LEDGER["site_generations"])
    twice = L.evolve_schema(once, schemas.LEDGER["site_generations"])
    assert once.columns == twice.columns
    assert set(schemas.LEDGER["site_generations"].fieldNames()) <= set(once.columns)
    assert once.first().template_type == "directory"


def test_append_and_read_ledger(spark, tmp_dir):
    from pagefleet.sources.files import read_ledger

    assert read_ledger(spark, tmp_dir, "jobs").count() == 0
    df = spark.createDataFrame([("j1", "scout", "queued")], "id string, kind string, status string")
    L.append_ledger(df, tmp_dir, "jobs")
    L.append_ledger(df.withColumn("status", F.lit("running")), tmp_dir, "jobs")
    assert read_ledger(spark, tmp_dir, "jobs").count() == 2


def test_latest_state_breaks_timestamp_ties(spark):
    t = datetime(2026, 1, 1)
    log = spark.createDataFrame([("a", "running", t, 1), ("a", "completed", t, 2), ("b", "queued", t, 1)],
                                "id string, status string, ts timestamp, seq long")
    out = {r.id: r.status for r in L.latest_state(log, "id", ["ts", "seq"]).collect()}
    assert out == {"a": "completed", "b": "queued"}


def test_reconcile_jobs(spark):
    jobs = spark.createDataFrame([("1", "scout", "running"), ("2", "scout", "queued"), ("3", "x", "queued"),
                                  ("4", "scout", "succeeded")], "id string, kind string, status string")
    acts = {r.id: r.action for r in L.reconcile_jobs(jobs, ["scout"]).collect()}
    assert acts == {"1": "fail", "2": "requeue", "3": "none"}
    c = L.reconcile_counts(L.reconcile_jobs(jobs, ["scout"])).first()
    assert (c.requeued, c.interrupted) == (1, 1)


def test_flags_and_cap(spark):
    m = spark.createDataFrame([(1, "/", 1010, 5, 0), (1, "/d", 240, 18, 0), (1, "/e", 300, 5, 0),
                               (1, "/f", 299, 0, 0)] + [(2, f"/p{i}", 500, 1, i) for i in range(12)],
                              "dep long, page_path string, impressions long, clicks long, pos long")
    flagged = TM.flag_underperformers(m)
    assert flagged.filter("dep = 1").count() == 2  # >= 300 and ctr < 0.02
    capped = TM.cap_flagged_pages(flagged, "dep", ["pos"], max_pages=10)
    assert capped.filter("dep = 2").count() == 10
    assert TM.flagged_count(flagged, "dep").filter("dep = 2").first().flagged == 12


def test_scorecard_empty_is_zero(spark):
    empty_logs = spark.createDataFrame([], "impressions long, clicks long, revenue_cents long")
    dep = spark.createDataFrame([("completed",), ("failed",)], "status string")
    opp = spark.createDataFrame([(1,)], "id long")
    r = D.traffic_scorecard(empty_logs, dep, opp).first()
    assert (r.impressions, r.clicks, r.ctr, r.revenue_usd, r.live_deployments, r.opportunities) == (0, 0, 0.0, 0.0,
                                                                                                      1, 1)


def test_rewrites_last_non_empty_wins(spark):
    meta = spark.createDataFrame([(1, "Old", "old d"), (2, "Keep", "keep d")], "site_id long, title string, "
                                                                               "description string")
    flagged = spark.createDataFrame([(1, 1), (1, 2)], "site_id long, seq long")
    ans = spark.createDataFrame([(1, 1, True, "First", "d1", ["a"]), (1, 2, True, "", "d2", [])],
                                "site_id long, seq long, ok boolean, title string, description string, "
                                "keywords array<string>")
    out = {r.site_id: r for r in TM.apply_rewrites(meta, flagged, ans).collect()}
    assert (out[1].title, out[1].description, out[1].optimized_keywords, out[1].optimized) == ("First", "d2",
                                                                                                ["a"], True)
    assert out[2].title == "Keep" and out[2].optimized is False


def test_job_stream_restart_has_no_duplicates(spark, tmp_dir):
    src = f"{tmp_dir}/transitions"
    t = datetime(2026, 1, 1)
    spark.createDataFrame([("a", "queued", t, 1)], "id string, status string, ts timestamp, seq long") \
        .write.parquet(src + "/b1")
    schema = "id string, status string, ts timestamp, seq long"
    out, ckpt = f"{tmp_dir}/log", f"{tmp_dir}/ckpt"

    def run():
        stream = spark.readStream.schema(schema).parquet(src + "/*")
        flows.run_update_to_log(flows.job_state_stream(stream), out, ckpt)

    run()
    spark.createDataFrame([("a", "running", t, 2), ("b", "queued", t, 1)], schema).write.parquet(src + "/b2")
    run()
    run()
    state = {r.id: r.status for r in flows.latest_from_log(spark, out, ["id"]).collect()}
    assert state == {"a": "running", "b": "queued"}


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


GOOD = {"data": {"viewer": {"accounts": [{"rumPageloadEventsAdaptiveGroups": [
    {"count": 900, "sum": {"visits": 6}, "dimensions": {"requestPath": "/"}}]}]}}}


def test_telemetry_stream_loses_no_payload(spark, tmp_dir):
    import json as _json
    import os

    idle = {"data": {"viewer": {"accounts": []}}}
    failed = {"data": None, "errors": [{"message": "no access"}, {}]}
    waves = [[_json.dumps(GOOD), "{broken", _json.dumps(idle)], [_json.dumps(failed), _json.dumps(GOOD), "[1]"]]
    for n, lines in enumerate(waves):
        os.makedirs(f"{tmp_dir}/in/deployment_id={n}")
        Path(f"{tmp_dir}/in/deployment_id={n}/p.txt").write_text("\n".join(lines) + "\n")
        for _ in range(2):  # the second time nothing is new
            flows.ingest_telemetry_stream(spark, f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ck").awaitTermination()
    rows = flows.read_output(spark, f"{tmp_dir}/out", "rows", flows.METRIC_ROWS).collect()
    assert sorted((r.deployment_id, r.page_path, r.impressions) for r in rows) == [(0, "/", 900), (1, "/", 900)]
    errors = flows.read_output(spark, f"{tmp_dir}/out", "errors", flows.ERROR_ROWS).collect()
    assert sorted((r.deployment_id, r.error) for r in errors) == [
        (0, "payload is not JSON"), (1, "no access; unknown error"), (1, "payload is not a JSON object")]
    assert tuple(flows.ingested(spark, f"{tmp_dir}/out").first()) == (6, 2, 1, 3)
    # A batch that was written but not committed is not read.
    spark.createDataFrame([(9, 0, "/x", 1, 1, 0, None)], flows.METRIC_ROWS).write.parquet(f"{tmp_dir}/out/rows/batch_id=99")
    assert flows.read_output(spark, f"{tmp_dir}/out", "rows", flows.METRIC_ROWS).count() == 2


def test_late_events_are_counted_and_kept(spark, tmp_dir):
    schema = "page_path string, event_type string, ts timestamp"
    at = lambda h, m=0: datetime(2026, 1, 1, h, m)
    waves = [[("/a", "view", at(1)), ("/a", "click", at(1, 30)), ("/a", "view", at(3))],
             [("/a", "view", at(1, 10)), ("/b", "view", at(2, 55)), ("/a", "view", at(3, 5)), ("/a", "view", None)],
             [("/b", "view", at(2, 59)), ("/b", "view", at(9))]]
    for n, rows in enumerate(waves):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_dir}/in/{n}")
        events = spark.readStream.schema(schema).parquet(f"{tmp_dir}/in/*")
        for _ in range(2):
            flows.page_metrics_stream(events, f"{tmp_dir}/out", f"{tmp_dir}/ck", ["page_path"]).awaitTermination()
    got = {(r.window_start.hour, r.page_path): (r.impressions, r.clicks)
           for r in flows.window_metrics(spark, f"{tmp_dir}/out", ["page_path"]).collect()}
    # Before the second batch the watermark is 2:50, so the window from 1 is closed and that from 2 open; before the third it is 2:55.
    assert got == {(1, "/a"): (1, 1), (2, "/b"): (2, 0), (3, "/a"): (2, 0), (9, "/b"): (1, 0)}
    late = flows.read_output(spark, f"{tmp_dir}/out", "late", schema).collect()
    assert {(r.page_path, r.ts) for r in late} == {("/a", None), ("/a", at(1, 10))} and len(late) == 2
    assert tuple(flows.window_counts(spark, f"{tmp_dir}/out").first()) == (9, 2)


def test_job_state_ends(spark, tmp_dir):
    schema = "id string, status string, ts timestamp, seq long"
    at = lambda h, m=0: datetime(2026, 1, 1, h, m)
    told = []
    waves = [[("a", "queued", at(1), 1), ("b", "queued", at(1), 1), ("c", "running", at(1), 1)],
             [("a", "running", at(1, 20), 2), ("a", "queued", at(0, 50), 0), ("b", "completed", at(1, 20), 2)],
             [("d", "queued", at(4), 1)], [("d", "failed", at(4, 10), 2), ("e", "queued", at(4, 10), 1)]]
    for n, rows in enumerate(waves):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_dir}/in/{n}")
        stream = flows.expiring_jobs_stream(spark.readStream.schema(schema).parquet(f"{tmp_dir}/in/*"))
        q = stream.writeStream.format("parquet").option("path", f"{tmp_dir}/out").option(
            "checkpointLocation", f"{tmp_dir}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        told.append(max(p["stateOperators"][0]["numRowsTotal"] for p in [q.lastProgress]))
    got = sorted((r.id, r.status, r.ts) for r in spark.read.parquet(f"{tmp_dir}/out").collect())
    assert got == [("a", "queued", at(1)), ("a", "running", at(1, 20)), ("a", "stale", at(1, 20)),
                   ("b", "completed", at(1, 20)), ("b", "queued", at(1)), ("c", "running", at(1)), ("c", "stale", at(1)),
                   ("d", "failed", at(4, 10)), ("d", "queued", at(4)), ("e", "queued", at(4, 10))]
    assert told[-1] == 1  # only "e" is held


def test_jobs_of_a_bucket_keep_their_own_state(spark, tmp_dir):
    """Jobs that share a bucket, one without a key among them, are told, expire and end each by itself."""
    schema = "id long, status string, ts timestamp, seq long"
    at = lambda h, m=0: datetime(2026, 1, 1, h, m)
    big = 2 ** 53 + 1  # a float would round it
    waves = [[(big, "queued", at(1), 1), (big + 1, "running", at(1), 1), (None, "running", at(1, 30), 1), (7, "completed", at(1), 1)],
             [(big, "running", at(1, 50), 2), (big, "failed", at(1, 40), 1)],
             [(8, "queued", at(2, 20), 1)], [(9, "queued", at(5), 1), (big, "queued", at(4, 55), 3)]]
    for n, rows in enumerate(waves):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_dir}/in/{n}")
        stream = flows.expiring_jobs_stream(spark.readStream.schema(schema).parquet(f"{tmp_dir}/in/*"), buckets=1)
        q = stream.writeStream.format("parquet").option("path", f"{tmp_dir}/out").option(
            "checkpointLocation", f"{tmp_dir}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        held = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    got = sorted(((r.id or 0, r.ts, r.seq, r.status) for r in spark.read.parquet(f"{tmp_dir}/out").collect()))
    assert got == [(0, at(1, 30), 1, "running"), (0, at(1, 30), 1, "stale"), (7, at(1), 1, "completed"),
                   (8, at(2, 20), 1, "queued"), (8, at(2, 20), 1, "stale"), (9, at(5), 1, "queued"),
                   (big, at(1), 1, "queued"), (big, at(1, 40), 1, "failed"), (big, at(1, 50), 2, "running"),
                   (big, at(4, 55), 3, "queued"), (big + 1, at(1), 1, "running"), (big + 1, at(1), 1, "stale")]
    assert held == 1  # one bucket for all jobs with a key
