"""Append-only pipeline state: writes, latest-state views, keys, schema evolution.

B1 append_ledger, F3 latest_state, F4 assign_keys (key_id, audit_keys), H4 evolve_schema,
C4 status_gate, C10 reconcile_jobs, C15 lookup_by_id, G7 pending limit.

Every status transition is a new appended row and the current state is a per-key
"latest" view; the commit log (``operators.commits``) keeps a run's rows from
counting twice and makes them safe under executor loss.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefleet.operators.commits import LedgerRun, evolve_schema  # noqa: F401 - H4 is part of this module's interface


def append_ledger(df: DataFrame, root: str, table: str, run: LedgerRun | None = None) -> None:
    """B1: append rows to one ledger table, conformed to its fixed schema.

    With ``run`` the rows belong to it and appear when it commits; without, they
    are a run of their own, committed here.
    """
    own = run or LedgerRun(df.sparkSession, root)
    own.append(df, table)
    if run is None:
        own.commit()


def latest_state(log: DataFrame, key: str | list[str], newest_by: list[str | Column]) -> DataFrame:
    """the current row per key: the row with the largest ``newest_by``
    (e.g. ``["updated_at", "seq"]``), nulls counting as oldest.

    ``newest_by`` must end in a tie-breaker (a sequence or id) since two
    transitions can share a timestamp. It is one ``max_by`` aggregate: the
    partial aggregate keeps one row per key and map task before the shuffle,
    so a key holding a third of all transitions is reduced map-side instead
    of being sorted in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in log.columns if c not in keys]
    order = F.struct(*[F.col(c) if isinstance(c, str) else c for c in newest_by])
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_s"))
    return latest.select(*keys, *[F.col(f"_s.`{c}`").alias(c) for c in others])


def key_halves(*parts: str | Column) -> tuple[Column, Column]:
    """The two signed 64-bit halves of the 128-bit key of ``parts`` (SHA-256, each part with its length)."""
    texts = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    named = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    digest = F.sha2(F.concat(*named).cast("binary"), 256)
    return tuple(F.conv(F.substring(digest, 1 + 16 * k, 16), 16, -10).cast("long") for k in (0, 1))


def key_id(*parts: str | Column) -> Column:
    """The ledger id of ``parts``: the first half of their key."""
    return key_halves(*parts)[0]


def assign_keys(df: DataFrame, run_id: str, natural_key: list[str]) -> DataFrame:
    """a deterministic surrogate key from (run id, natural key): ``id`` and ``id_low``, 128 bits together.

    No global ordering, no driver round trip: the same input gives the same
    keys on a retry, so appends stay idempotent. ``id`` is what the ledger
    tables hold; ``audit_keys`` tells whether it stands for one row only.
    """
    high, low = key_halves(run_id, *[F.col(c) for c in natural_key])
    return df.withColumn("id", high).withColumn("id_low", low)


class KeyCollision(RuntimeError):
    """Two different rows got one ledger id."""


def audit_keys(keyed: DataFrame) -> DataFrame:
    """The ids that stand for more than one 128-bit key, with their number (empty: every id is sound)."""
    return keyed.groupBy("id").agg(F.count_distinct("id_low").alias("keys")).where("keys > 1")


def checked_keys(keyed: DataFrame) -> DataFrame:
    """``keyed`` without ``id_low``; raises ``KeyCollision`` where an id stands for two keys."""
    clash = audit_keys(keyed).limit(1).collect()
    if clash:
        raise KeyCollision(f"ledger id {clash[0]['id']} stands for {clash[0]['keys']} different rows")
    return keyed.drop("id_low")


def status_gate(df: DataFrame, status_col: str, required: str, message: str | None = None
                ) -> tuple[DataFrame, DataFrame]:
    """C4: (rows with the required status, the rest as REJECTED outcome rows)."""
    ok = F.col(status_col) == F.lit(required)
    passed = df.filter(ok)
    text = message or f"status is {{}}, not {required}"
    rejected = df.filter(~ok | F.col(status_col).isNull()).withColumn("outcome", F.lit("REJECTED")).withColumn(
        "message", F.format_string(text.replace("{}", "%s"), F.coalesce(F.col(status_col), F.lit("null")))
    )
    return passed, rejected


def pending_limit(df: DataFrame, status_col: str, pending: str, limit: int | None, order_by: str = "id") -> DataFrame:
    """The first ``limit`` pending rows (ordered by id; Q10)."""
    rows = df.filter(F.col(status_col) == pending)
    return rows.orderBy(order_by).limit(limit) if limit is not None else rows


def reconcile_jobs(jobs: DataFrame, known_kinds: list[str], status_col: str = "status",
                   kind_col: str = "kind") -> DataFrame:
    """Orphaned jobs after a restart with the action each one gets.

    running -> ``fail`` (error ``interrupted by restart``, finished now);
    queued of a known kind -> ``requeue``; queued of an unknown kind -> ``none``.
    """
    orphan = jobs.filter(F.col(status_col).isin("queued", "running"))
    st = F.col(status_col)
    action = (
        F.when(st == "running", F.lit("fail"))
        .when(F.col(kind_col).isin(*known_kinds), F.lit("requeue"))
        .otherwise(F.lit("none"))
    )
    return (
        orphan.withColumn("action", action)
        .withColumn("new_status", F.when(st == "running", F.lit("failed")).otherwise(st))
        .withColumn("error", F.when(st == "running", F.lit("interrupted by restart")))
    )


def reconcile_counts(actions: DataFrame) -> DataFrame:
    """C10 totals: one row with ``requeued`` and ``interrupted``."""
    return actions.agg(
        F.count_if(F.col("action") == "requeue").alias("requeued"),
        F.count_if(F.col("action") == "fail").alias("interrupted"),
    )


def lookup_by_id(df: DataFrame, id_col: str, value: Any) -> DataFrame:
    """The row with this primary key; empty when absent (pushed to the scan)."""
    return df.filter(F.col(id_col) == F.lit(value))
