"""B1: retry-safe appends through a commit log.

A stage run writes its rows under ``<ledger>/<table>/run=<run>/attempt=<attempt>``
and is nothing to a reader until its manifest exists: one small file
``<ledger>/commits/<run>.json`` that names the valid attempt, published by one
rename that fails where another attempt's manifest is already there. So a run
counts once, however often it is tried and wherever an earlier try stopped; its
rows of all tables appear together; and another run of the same stage (the next
poll, say) is a snapshot of its own.

Readers meet the data files with the manifests by a join on (run, attempt).
"""

from __future__ import annotations

import hashlib
import json
import traceback
import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagefleet import schemas
from pagefleet.functions import scalar

COMMITS = "commits"
MANIFEST = T.StructType([T.StructField("run", T.StringType()), T.StructField("attempt", T.StringType()),
                         T.StructField("tables", T.ArrayType(T.StringType()))])


def _path(spark: SparkSession, path: str):
    """The path and its file system (driver-side metadata calls only)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001


def evolve_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """H4: add every column of ``schema`` missing from ``df`` as a typed null.

    Existing columns are never altered or dropped; applying it twice changes
    nothing.
    """
    present = set(df.columns)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in present}
    return df.withColumns(missing) if missing else df


class LedgerRun:
    """One attempt of a stage run: ``append`` rows of any tables, then ``commit`` once.

    ``run_id`` names the run; without one the run is its own. A run that is
    already committed stays as it is: ``commit`` then returns False and this
    attempt's files are never read.
    """

    def __init__(self, spark: SparkSession, root: str, run_id: str | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.run_id = run_id if run_id is not None else uuid.uuid4().hex
        # A name for any run id, hidden from no listing; one that had to be changed keeps apart by a digest.
        plain = quote(self.run_id, safe="").replace("%", "_")
        known = plain == self.run_id and plain[:1] not in ("", "_", ".")
        self.run = plain if known else f"r{hashlib.sha256(self.run_id.encode()).hexdigest()[:16]}-{plain}"
        self.attempt = uuid.uuid4().hex
        self.tables: list[str] = []

    def append(self, df: DataFrame, table: str) -> None:
        """Write rows, conformed to the table's fixed schema; they count once the run commits."""
        schema = schemas.LEDGER[table]
        rows = evolve_schema(df, schema).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        # Several appends of one run to one table lie side by side.
        part = len(self.tables)
        rows.write.parquet(f"{self.root}/{table}/run={self.run}/attempt={self.attempt}/part={part}")
        self.tables.append(table)

    def commit(self) -> bool:
        """Publish this attempt; False where the run had been committed before."""
        folder, fs = _path(self.spark, f"{self.root}/{COMMITS}")
        fs.mkdirs(folder)
        target, _ = _path(self.spark, f"{self.root}/{COMMITS}/{self.run}.json")
        draft, _ = _path(self.spark, f"{self.root}/{COMMITS}/.{self.run}.{self.attempt}")
        body = json.dumps({"run": self.run, "attempt": self.attempt, "tables": sorted(set(self.tables))})
        out = fs.create(draft, True)
        try:
            out.write(bytearray(body, "utf-8"))
        finally:
            out.close()
        # Local file systems replace the target of a rename, so look first; HDFS refuses by itself.
        done = not fs.exists(target) and fs.rename(draft, target)
        if not done:
            fs.delete(draft, False)
        return bool(done)


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """``run, attempt, tables`` of every committed run."""
    folder, fs = _path(spark, f"{root.rstrip('/')}/{COMMITS}")
    if not fs.exists(folder):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{root.rstrip('/')}/{COMMITS}")


def committed_rows(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of one ledger table that belong to committed attempts (empty when never written)."""
    schema = schemas.LEDGER[table]
    path = f"{root.rstrip('/')}/{table}"
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    names = T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("attempt", T.StringType()),
                          T.StructField("part", T.IntegerType())])
    rows = spark.read.schema(names).option("mergeSchema", "true").parquet(path)
    valid = manifests(spark, root).select("run", "attempt")
    return rows.join(valid, ["run", "attempt"], "left_semi").select(*schema.names)


#: The table that records a failed run of each stage, and where its trace goes.
FAILURES = {
    "scout": ("scout_jobs", "log_trace"),
    "compile": ("site_generations", "log_trace"),
    "deploy": ("deployments", "log_trace"),
    "optimize": ("optimizations", "detail"),
}


def run_stage(
    spark: SparkSession,
    ledger: str,
    stage: str,
    run_id: str,
    body: Callable[[], dict[str, DataFrame]],
    key: Column,
    fields: dict[str, Column] | None = None,
) -> dict[str, DataFrame]:
    """Run one stage; a failure becomes a row of the ledger instead of an exception.

    ``body`` does the work and returns the stage's frames. Where it raises, a
    row with ``status`` ``failed`` and the trace is committed to the stage's
    table under ``key`` (the id that a later, successful try of the same run
    updates) and the result is one frame ``status`` with the error. ``fields``
    fill further columns of that row.
    """
    try:
        return body()
    except Exception as exc:  # noqa: BLE001 - a stage's failure is data
        table, trace = FAILURES[stage]
        # Its own run, so that trying the stage again can still commit under run_id.
        run = LedgerRun(spark, ledger, f"{run_id}!failed!{uuid.uuid4().hex}")
        row = spark.range(1).select(key.alias("id"), F.lit("failed").alias("status"),
                                    F.lit(traceback.format_exc()).alias(trace), scalar.stamp().alias("created_at"),
                                    scalar.stamp().alias("updated_at"),
                                    *[c.alias(n) for n, c in (fields or {}).items()])
        run.append(row, table)
        run.commit()
        return {"status": spark.createDataFrame(
            [("AGENT_ACTION_REQUIRED", type(exc).__name__, str(exc))], "status string, error_type string, message string")}
