"""Fleet dashboard queries over the state tables.

E3 traffic_scorecard, E4 table_counts, E5 counts_by_status, C9 live_sites,
G2 top_k, G3 recent, H2 latest_errors (with C8, G8), D1 evaluation_listing,
E6 run report totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefleet.functions import scalar


def traffic_scorecard(logs: DataFrame, deployments: DataFrame, opportunities: DataFrame,
                      completed: str = "completed") -> DataFrame:
    """One row of sums (0 when empty), ctr rounded 4, revenue USD rounded 2,
    completed deployments and opportunity count. Three global aggregates,
    each partial+final, joined as one-row frames."""
    sums = logs.agg(
        F.coalesce(F.sum("impressions"), F.lit(0)).cast("long").alias("impressions"),
        F.coalesce(F.sum("clicks"), F.lit(0)).cast("long").alias("clicks"),
        F.coalesce(F.sum("revenue_cents"), F.lit(0)).cast("long").alias("revenue_cents"),
    )
    live = deployments.agg(F.count_if(F.col("status") == completed).alias("live_deployments"))
    opps = opportunities.agg(F.count(F.lit(1)).alias("opportunities"))
    return sums.crossJoin(live).crossJoin(opps).select(
        scalar.cents_to_usd("revenue_cents").alias("revenue_usd"),
        "impressions",
        "clicks",
        scalar.ctr("clicks", "impressions", 4).alias("ctr"),
        "live_deployments",
        "opportunities",
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, rows`` for every named table (count from metadata when the
    source allows it)."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def counts_by_status(df: DataFrame, status: str = "status") -> DataFrame:
    """E5: ``status, n`` group counts."""
    return df.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def live_sites(deployments: DataFrame) -> DataFrame:
    """Deployments with a live URL, whatever their status."""
    return deployments.filter(F.col("live_url").isNotNull()).select(
        F.col("id").alias("deployment_id"), "project_slug", "live_url", "status"
    )


def top_k(df: DataFrame, k: int, by: str, tie: str = "id") -> DataFrame:
    """Top-k by a score, descending (bounded TakeOrderedAndProject)."""
    return df.orderBy(F.desc(by), F.asc(tie)).limit(k)


def recent(df: DataFrame, k: int, ts: str = "created_at", tie: str = "id") -> DataFrame:
    """Newest k rows."""
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(k)


def latest_errors(branches: list[tuple[str, DataFrame, str]], limit: int = 20,
                  failed: str = "failed", status: str = "status") -> DataFrame:
    """H2 (C8, G8): failed rows of several tables as ``kind, id, trace``.

    Each branch is ``(kind, table, trace column)``; ``limit`` applies per
    table (ordered by id, Q10) and then overall in branch order.
    """
    out = None
    for ordinal, (kind, df, trace) in enumerate(branches):
        part = (
            df.filter(F.col(status) == failed)
            .select(F.lit(ordinal).alias("_ord"), F.lit(kind).alias("kind"), F.col("id"),
                    F.col(trace).cast("string").alias("trace"))
            .orderBy("id").limit(limit)
        )
        out = part if out is None else out.unionByName(part)
    return out.orderBy("_ord", "id").limit(limit).drop("_ord")


def evaluation_listing(evaluations: DataFrame, opportunities: DataFrame, limit: int = 20) -> DataFrame:
    """Evaluations ⟕ opportunities, niche ``-`` when missing, newest first.

    Cut before the join: an opportunity has one row, so the newest evaluations are the listing's.
    """
    newest = [F.desc("created_at"), F.desc("id")]
    o = opportunities.select(F.col("id").alias("_oid"), F.col("niche_id"))
    cut = evaluations.orderBy(*newest).limit(limit)
    j = cut.join(o, F.col("opportunity_id") == F.col("_oid"), "left")
    return j.withColumn("niche_id", F.coalesce("niche_id", F.lit("-"))).drop("_oid").orderBy(*newest)


def outcome_totals(outcomes: DataFrame, status: str = "status") -> DataFrame:
    """One row of per-run totals from per-item outcome rows."""
    st = F.col(status)
    return outcomes.agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.count_if(st == "APPROVED").alias("approved"),
        F.count_if(st == "REJECTED").alias("rejected"),
        F.count_if(st == "FAILED").alias("failed"),
    )
