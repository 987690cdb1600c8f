"""Streaming queries (J1 J2 J3): each runs its stream to completion with
``availableNow`` on a fresh checkpoint in the shared folder, restarts it once
on the same checkpoint (no duplicates may appear), and returns the final state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefleet.plans.fleet_queries import _EV_CTE, page_metric_rows
from pagefleet.plans.registry import register, table
from pagefleet.session import scratch_dir
from pagefleet.streaming import flows


def landed_payloads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, str, str]:
    """Analytics payloads of the events' page metrics, and folders for a stream over them."""
    pm = page_metric_rows(spark, sf_dir)
    group = F.struct(F.col("impressions").alias("count"), F.struct(F.col("clicks").alias("visits")).alias("sum"),
                     F.struct(F.col("page_path").alias("requestPath")).alias("dimensions"))
    # At most 100 groups per payload (the analytics API's page size).
    payloads = pm.groupBy("deployment_id", F.floor(F.col("k") / 100).alias("chunk")).agg(
        F.collect_list(group).alias("g")).select(
        "deployment_id",
        F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(F.col("g").alias(
            "rumPageloadEventsAdaptiveGroups"))).alias("accounts")).alias("viewer")).alias("data"))).alias("value"),
    )
    landing, out, ckpt = (scratch_dir(spark, n) for n in ("landing", "analytics_logs", "telemetry-ckpt"))
    return payloads, landing, out, ckpt


def ingest_waves(spark: SparkSession, sf_dir: str) -> str:
    """Payloads landed in two waves, with failed and empty ones between them; ingested by one stream that restarts."""
    payloads, landing, out, ckpt = landed_payloads(spark, sf_dir)
    deps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("deployment_id"), "o_orderstatus")
    other = deps.select("deployment_id", F.when(F.col("o_orderstatus") == "P", F.lit('{"errors":[{"message":"no access"}]}')).when(
        F.col("o_orderstatus") == "O", F.lit('{"data":{}}')).otherwise(F.lit("{broken")).alias("value"))
    every = payloads.unionByName(other.select((F.col("deployment_id") % 10).alias("deployment_id"), "value"))
    for wave in (F.col("deployment_id") < 5, F.col("deployment_id") >= 5):
        every.where(wave).repartition("deployment_id").write.mode("append").partitionBy("deployment_id").text(landing)
        flows.ingest_telemetry_stream(spark, landing, out, ckpt).awaitTermination()
    flows.ingest_telemetry_stream(spark, landing, out, ckpt).awaitTermination()  # no new files: no rows
    return out


@register(
    "telemetry_stream",
    f"WITH {_EV_CTE} SELECT deployment_id, page_path, impressions, clicks, CAST(0 AS BIGINT) AS revenue_cents FROM pm",
)
def telemetry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric rows of all payloads, across a restart."""
    rows = flows.read_output(spark, ingest_waves(spark, sf_dir), "rows", flows.METRIC_ROWS)
    return rows.select("deployment_id", "page_path", "impressions", "clicks", "revenue_cents")


@register(
    "telemetry_counts",
    f"""WITH {_EV_CTE}, p AS (SELECT DISTINCT deployment_id, floor(k / 100) AS chunk FROM pm)
SELECT (SELECT count(*) FROM p) + (SELECT count(*) FROM orders) AS payloads, (SELECT count(*) FROM p) AS with_rows,
       (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS empty, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'O') AS failed,
       (SELECT count(*) FROM orders WHERE o_orderstatus <> 'O') AS errors_kept,
       (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS errors_told""",
)
def telemetry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads in = with rows + empty + failed, and every failed payload is kept with its error."""
    out = ingest_waves(spark, sf_dir)
    errors = flows.read_output(spark, out, "errors", flows.ERROR_ROWS).agg(
        F.count("*").alias("errors_kept"), F.count_if(F.col("error") == "no access").alias("errors_told"))
    return flows.ingested(spark, out).crossJoin(errors)  # one row each


def event_waves(spark: SparkSession, sf_dir: str) -> str:
    """Events in three waves, the first ten days, the others, and a tenth of all as stragglers; J2 over them."""
    ev = table(spark, sf_dir, "events").withColumn("page_path", F.concat(F.lit("/p/"), F.get_json_object("props", "$.k")))
    ev = ev.select("event_id", "ts", "event_type", "page_path")
    first = ev.agg(F.min(F.date_trunc("day", "ts")).alias("first"))
    day = F.datediff(F.col("ts"), F.col("first"))
    ev = ev.crossJoin(F.broadcast(first)).withColumn("day", day).drop("first")  # one row
    landing, out, ckpt = (scratch_dir(spark, n) for n in ("events", "metrics", "metrics-ckpt"))
    straggler = F.col("event_id") % 10 == 0
    for n, wave in enumerate(((F.col("day") < 10) & ~straggler, (F.col("day") >= 10) & ~straggler, straggler)):
        ev.where(wave).drop("day").write.parquet(f"{landing}/wave={n}")
        stream = spark.readStream.schema("event_id long, ts timestamp, event_type string, page_path string").parquet(f"{landing}/*")
        for _ in range(2):  # restarted: nothing new
            flows.page_metrics_stream(stream, out, ckpt, ["page_path"], window="1 day", delay="1 hour").awaitTermination()
    return out


_LATE_CTE = f"""
{_EV_CTE},
timed AS (SELECT *, '/p/' || CAST(k AS VARCHAR) AS page_path, date_trunc('day', ts) AS window_start,
                 date_diff('day', (SELECT min(date_trunc('day', ts)) FROM ev), ts) AS day, event_id % 10 = 0 AS straggler FROM ev),
mark AS (SELECT max(ts) FILTER (day < 10 AND NOT straggler) - INTERVAL 1 HOUR AS second,
                max(ts) FILTER (NOT straggler) - INTERVAL 1 HOUR AS third FROM timed),
judged AS (SELECT timed.*, CASE WHEN straggler THEN window_start + INTERVAL 1 DAY <= third
                                WHEN day >= 10 THEN window_start + INTERVAL 1 DAY <= second ELSE false END AS late FROM timed, mark)"""


@register(
    "metrics_stream",
    f"WITH {_LATE_CTE} SELECT window_start, page_path, "
    "CAST(count_if(event_type = 'view') AS BIGINT) AS impressions, "
    "CAST(count_if(event_type = 'click') AS BIGINT) AS clicks FROM judged WHERE NOT coalesce(late, false) GROUP BY 1, 2",
)
def metrics_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windowed page metrics from three batches of events, the last of which mostly comes too late."""
    sums = flows.window_metrics(spark, event_waves(spark, sf_dir), ["page_path"])
    return sums.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "page_path", "impressions", "clicks")


@register(
    "metrics_late",
    f"WITH {_LATE_CTE} SELECT count(*) AS events, CAST(count_if(late) AS BIGINT) AS late, CAST(count_if(late) AS BIGINT) AS kept, "
    "CAST(coalesce(sum(event_id) FILTER (late), 0) AS BIGINT) AS ids FROM judged",
)
def metrics_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late events are counted by every batch and kept whole in the side output."""
    out = event_waves(spark, sf_dir)
    kept = flows.read_output(spark, out, "late", "event_id long").agg(
        F.count("*").alias("kept"), F.coalesce(F.sum("event_id"), F.lit(0)).alias("ids"))
    return flows.window_counts(spark, out).crossJoin(kept)  # one row each


@register(
    "job_stream",
    "SELECT o_custkey AS id, o_orderstatus AS status, o_orderdate AS ts, o_orderkey AS seq FROM ("
    "SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn "
    "FROM orders) WHERE rn = 1",
)
def job_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest status per job from a transition stream."""
    schema = table(spark, sf_dir, "orders").schema
    o = spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/orders*.parquet")
    tr = o.select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"),
                  F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"))
    state = flows.job_state_stream(tr)
    out, ckpt = scratch_dir(spark, "jobs-log"), scratch_dir(spark, "jobs-ckpt")
    flows.run_update_to_log(state, out, ckpt)
    return flows.latest_from_log(spark, out, ["id"])


@register(
    "job_expiry",
    """WITH jobs AS (SELECT o_custkey AS id, max_by(CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'running' END,
                            (o_orderdate, o_orderkey)) AS status, max((o_orderdate, o_orderkey)) AS newest FROM orders GROUP BY 1)
SELECT id, CASE WHEN status = 'running' AND newest[1] + INTERVAL 30 DAY < (SELECT max(o_orderdate) FROM orders) - INTERVAL 1 DAY
           THEN 'stale' ELSE status END AS status FROM jobs""",
)
def job_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's last told status, where a job that was silent for 30 days is stale and holds no state."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("seq"))
    landing, out, ckpt = (scratch_dir(spark, n) for n in ("transitions", "jobs", "jobs-ckpt"))
    o.write.parquet(f"{landing}/all")
    stream = flows.expiring_jobs_stream(spark.readStream.schema(o.schema).parquet(f"{landing}/*"), "30 days", "1 day")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(
        availableNow=True).start().awaitTermination()
    # A stale row comes after the transition it follows.
    told = spark.read.parquet(out).withColumn("late", (F.col("status") == "stale").cast("int"))
    return told.groupBy("id").agg(F.max_by("status", F.struct("ts", "seq", "late")).alias("status"))
