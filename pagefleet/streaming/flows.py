"""Structured Streaming flows: J1 telemetry ingestion, J2 windowed page
metrics, J3 job state.

All flows take a checkpoint location in the shared folder, so a restarted
(or re-triggered ``availableNow``) query resumes where it stopped and never
duplicates a committed batch. J1 and J2 write each micro-batch to several outputs
under its batch id and commit it by one file, which also tells its counts (J2: and the
watermark), so readers see all of a batch or none. J3 is written in update
mode as an append-only log keyed by batch id (a
replayed batch overwrites its own folder), whose current view is F3
(latest per key), or with a state that ends (``expiring_jobs_stream``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagefleet.functions import scalar
from pagefleet.operators import ledger as L
from pagefleet.sources import payloads as PL


def _batch_log_writer(out_dir: str):
    """foreachBatch sink: each micro-batch goes to ``out_dir/batch_id=<id>``;
    a replay after a failure overwrites the same folder (idempotent)."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
            f"{out_dir.rstrip('/')}/batch_id={batch_id}"
        )

    return write


def _publish(spark: SparkSession, out_dir: str, batch_id: int, told: dict) -> None:
    """Commit a micro-batch: one small file, by one rename. A replayed batch publishes the same file again."""
    jvm = spark._jvm  # noqa: SLF001 - driver-side metadata calls only
    folder = jvm.org.apache.hadoop.fs.Path(f"{out_dir}/batches")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    fs.mkdirs(folder)
    draft, target = (jvm.org.apache.hadoop.fs.Path(folder, n) for n in (f".{batch_id}.draft", f"{batch_id}.json"))
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps({"batch_id": batch_id, **told}), "utf-8"))
    finally:
        out.close()
    if fs.exists(target):  # an earlier try of this batch
        fs.delete(target, False)
    if not fs.rename(draft, target):
        raise RuntimeError(f"batch {batch_id} could not be committed")


def read_batches(spark: SparkSession, out_dir: str, schema: str) -> DataFrame:
    """The committed batches with what was told of each (``schema`` without ``batch_id``)."""
    root = out_dir.rstrip("/")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/batches")  # noqa: SLF001
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):  # noqa: SLF001
        return spark.createDataFrame([], f"batch_id long, {schema}")
    return spark.read.schema(f"batch_id long, {schema}").json(f"{root}/batches")


def read_output(spark: SparkSession, out_dir: str, name: str, schema: str) -> DataFrame:
    """The rows of output ``name`` that belong to committed batches."""
    done = read_batches(spark, out_dir, "payloads long").select("batch_id")
    root = f"{out_dir.rstrip('/')}/{name}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)  # noqa: SLF001
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):  # noqa: SLF001
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch_id long").parquet(root)
    return rows.join(done, "batch_id", "left_semi").drop("batch_id")


#: What J1 writes, and what it tells of a batch.
METRIC_ROWS = ("deployment_id long, group_pos int, page_path string, impressions long, clicks long, revenue_cents long, "
               "captured_at timestamp")
ERROR_ROWS = "deployment_id long, value string, error string"
INGESTED = "payloads long, with_rows long, empty long, failed long"


def ingest_telemetry_stream(
    spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, available_now: bool = True,
) -> StreamingQuery:
    """New analytics payload files -> parsed page metrics -> appended rows
    with ``captured_at``. One payload per line; the deployment id comes from
    the ``deployment_id=<n>`` folder of the file.

    No payload vanishes: a micro-batch writes its metric rows to ``rows``, and the
    payloads that don't parse or carry ``errors`` to ``errors``, both under its batch
    id; then one file commits the batch, with the numbers of its payloads, of those with
    rows, of empty ones and of failed ones. A replayed batch overwrites its own
    folders, so after any restart payloads in = with rows + empty + failed
    (``ingested``). Read the outputs with ``read_output``.
    """
    out_dir = out_dir.rstrip("/")
    raw = spark.readStream.text(in_dir).select(
        F.regexp_extract(F.input_file_name(), r"deployment_id=([0-9]+)", 1).cast("long").alias("deployment_id"),
        F.col("value"),
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        at = f"batch_id={batch_id}"
        told = Observation()
        judged = PL.judge_rum_payloads(batch).observe(
            told, F.count(F.lit(1)).alias("payloads"), F.count_if(F.col("error").isNotNull()).alias("failed"),
            F.count_if(F.col("error").isNull() & (F.col("groups") == 0)).alias("empty"))
        judged.where("error IS NOT NULL").select("deployment_id", "value", "error").write.mode("overwrite").parquet(
            f"{out_dir}/errors/{at}")
        rows = PL.parse_rum_groups(PL.judge_rum_payloads(batch).where("error IS NULL"), keep=["deployment_id"])
        rows.withColumn("captured_at", scalar.stamp()).write.mode("overwrite").parquet(f"{out_dir}/rows/{at}")
        n = told.get
        _publish(spark, out_dir, batch_id, {**n, "with_rows": n["payloads"] - n["failed"] - n["empty"]})

    writer = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def ingested(spark: SparkSession, out_dir: str) -> DataFrame:
    """J1 totals over the committed batches: one row ``payloads, with_rows, empty, failed``."""
    names = ("payloads", "with_rows", "empty", "failed")
    return read_batches(spark, out_dir, INGESTED).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))


#: What J2 writes for each window and key (after the keys), and what it tells of a batch.
WINDOW_ROWS = "window_start timestamp, impressions long, clicks long, revenue_cents long"


def page_metrics_stream(
    events: DataFrame,
    out_dir: str,
    checkpoint: str,
    keys: list[str],
    window: str = "1 hour",
    delay: str = "10 minutes",
    revenue=None,
    ts: str = "ts",
    event_type: str = "event_type",
) -> StreamingQuery:
    """Event-time windowed impressions / clicks / revenue per key, late events kept apart.

    The watermark of a batch is the largest event time of the batches before it
    less ``delay``. An event whose window had ended by then is late: its window was
    reported as closed. A micro-batch writes the sums of its other events to ``metrics``
    and its late events, whole, to ``late``, then commits both with the next watermark
    and its counts. So no event vanishes, and nothing but the last watermark is held
    between batches, whatever the number of pages. ``window_metrics`` reads the sums.
    """
    spark, out_dir = events.sparkSession, out_dir.rstrip("/")
    schema = "payloads long, late long, watermark timestamp"
    late_by = F.expr(f"INTERVAL {delay}")
    width = int(pd.Timedelta(window).total_seconds() * 1_000_000)
    et = F.col(event_type)
    rev = revenue if revenue is not None else F.lit(0)

    def timed(batch: DataFrame, mark) -> DataFrame:
        """The batch's events with their window, and whether they are late (an event without a time is)."""
        micros = F.unix_micros(F.col(ts).cast("timestamp"))
        rows = batch.withColumn("window_start", F.timestamp_micros(micros - F.pmod(micros, F.lit(width))))
        open_ = F.lit(True) if mark is None else F.timestamp_micros(F.unix_micros("window_start") + width) > F.lit(mark)
        return rows.withColumn("_late", ~F.coalesce(open_ & F.col("window_start").isNotNull(), F.lit(False)))

    def write(batch: DataFrame, batch_id: int) -> None:
        before = read_batches(spark, out_dir, schema).where(F.col("batch_id") < batch_id)
        mark = before.agg(F.max("watermark").alias("m")).first()["m"]
        told, at = Observation(), f"batch_id={batch_id}"
        rows = timed(batch, mark).observe(
            told, F.count(F.lit(1)).alias("payloads"), F.count_if("_late").alias("late"),
            F.max(F.col(ts).cast("timestamp")).alias("newest"))
        rows.where("NOT _late").groupBy("window_start", *keys).agg(
            F.count_if(et == "view").alias("impressions"), F.count_if(et == "click").alias("clicks"),
            F.coalesce(F.sum(F.when(et == "purchase", rev.cast("long"))), F.lit(0).cast("long")).alias("revenue_cents"),
        ).write.mode("overwrite").parquet(f"{out_dir}/metrics/{at}")
        n = told.get
        if n["late"]:
            timed(batch, mark).where("_late").drop("window_start", "_late").write.mode("overwrite").parquet(f"{out_dir}/late/{at}")
        after = mark if n["newest"] is None else spark.range(1).select(F.greatest(
            F.lit(n["newest"]) - late_by, F.lit(mark).cast("timestamp"))).first()[0]
        _publish(spark, out_dir, batch_id, {"payloads": n["payloads"], "late": n["late"],
                                            "watermark": None if after is None else f"{after:%Y-%m-%dT%H:%M:%S.%f}Z"})

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_metrics(spark: SparkSession, out_dir: str, keys: list[str]) -> DataFrame:
    """The current sums per window and key over the committed batches."""
    named = ", ".join(f"{k} string" for k in keys)
    sums = read_output(spark, out_dir, "metrics", f"{WINDOW_ROWS}, {named}")
    return sums.groupBy("window_start", *keys).agg(*(F.sum(c).alias(c) for c in ("impressions", "clicks", "revenue_cents")))


def window_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """One row ``events, late`` over the committed batches."""
    return read_batches(spark, out_dir, "payloads long, late long").agg(
        F.coalesce(F.sum("payloads"), F.lit(0)).alias("events"), F.coalesce(F.sum("late"), F.lit(0)).alias("late"))


def flag_stream(metrics: DataFrame, min_impressions: int, max_ctr: float) -> DataFrame:
    """J2 + C5: flags over windowed metrics (apply to closed windows, i.e. in
    append mode, or to the latest state of an update-mode log)."""
    ratio = scalar.ctr("clicks", "impressions")
    return metrics.filter((F.col("impressions") >= min_impressions) & (ratio < max_ctr))


def job_state_stream(transitions: DataFrame, key: str = "id", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Latest status per job from a stream of transitions (update mode).

    ``max_by`` over (ts, seq) keeps one struct per key in the state store.
    """
    cols = [c for c in transitions.columns if c != key]
    return transitions.groupBy(key).agg(
        F.max_by(F.struct(*cols), F.struct(F.col(ts), F.col(seq))).alias("s")
    ).select(key, "s.*")


#: Statuses after which a job changes no more.
FINISHED = ("completed", "failed")


def expiring_jobs_stream(transitions: DataFrame, silence: str = "1 hour", delay: str = "10 minutes", key: str = "id",
                         ts: str = "ts", seq: str = "seq", buckets: int = 4096) -> DataFrame:
    """J3 with an end: rows ``id, status, ts, seq`` where a job's status changed, from transitions of these columns.

    A job's state is its newest (ts, seq, status). A finished job is told once and its
    state ends; one that has been silent for ``silence`` of event time is told as
    ``stale`` and its state ends as well (a later transition begins anew). So the state holds the jobs
    that moved within ``silence``, not every job there ever was. Write it in append mode.

    Jobs share a state by the hash of their key, so that a call of the step serves all of a
    bucket's jobs (a call for each job took most of the time). ``buckets`` holds for a checkpoint's whole life.
    """
    quiet = int(pd.Timedelta(silence).total_seconds() * 1000)

    def step(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told, mark = [], state.getCurrentWatermarkMs()
        held = {i: (at, order, status) for i, at, order, status, _ in zip(*state.get)} if state.exists else {}
        until = dict(zip(state.get[0], state.get[4])) if state.exists else {}
        moved = set()
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values([ts, seq], kind="stable")
            ids = rows[key].tolist() if bucket[0] >= 0 else [None] * len(rows)
            for i, status, at, order in zip(ids, rows["status"], rows[ts], rows[seq]):
                moved.add(i)
                new, old = (int(at.value // 1000), int(order), status), held.get(i)
                if old is not None and new[:2] <= old[:2]:
                    continue  # older than what is known
                if old is None or old[2] != status:
                    told.append((i, status, at, int(order)))
                held[i] = new
        for i in moved:
            until[i] = max(held[i][0] // 1000 + quiet, mark + 1)
            if held[i][2] in FINISHED:
                del held[i]
        for i in [i for i in held if i not in moved and until[i] < mark]:
            at, order, _ = held.pop(i)
            told.append((i, "stale", pd.Timestamp(at, unit="us"), order))
        if held:
            state.update((list(held), *map(list, zip(*held.values())), [until[i] for i in held]))
            state.setTimeoutTimestamp(min(until[i] for i in held))
        elif state.exists:
            state.remove()
        if told:
            yield pd.DataFrame(told, columns=["id", "status", "ts", "seq"])

    kind = transitions.schema[key].dataType.simpleString()
    # Jobs without a key have a bucket of their own: beside them pandas would hold whole numbers as floats.
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)))
    return transitions.withWatermark(ts, delay).withColumn("_bucket", bucket).groupBy("_bucket").applyInPandasWithState(
        step, f"id {kind}, status string, ts timestamp, seq long",
        f"id array<{kind}>, at array<long>, seq array<long>, status array<string>, until array<long>", "append",
        GroupStateTimeout.EventTimeTimeout)


def run_update_to_log(stream: DataFrame, out_dir: str, checkpoint: str) -> None:
    """Run an aggregating stream to completion (``availableNow``) in update mode
    into a batch-keyed log folder."""
    q = (stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(_batch_log_writer(out_dir)).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def latest_from_log(spark: SparkSession, out_dir: str, keys: list[str], schema: T.StructType | None = None
                    ) -> DataFrame:
    """The current value per key of an update-mode log (the last batch wins)."""
    log = spark.read.parquet(out_dir) if schema is None else spark.read.schema(schema).parquet(out_dir)
    return L.latest_state(log, keys, ["batch_id"]).drop("batch_id")
