"""Deployment records (no upload): D2 resolve_targets, I27 deployment_plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefleet.functions import text


def resolve_targets(sites: DataFrame, evaluations: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Generation -> evaluation -> opportunity over two nullable FK hops.

    Adds ``niche_id`` and ``project_slug`` (I3 of the niche, else I6 of the
    build path, else ``site-{id}``). Two left joins keyed on ids; both sides
    are shuffled on the key unless small enough for AQE to broadcast.
    """
    ev = evaluations.select(F.col("id").alias("_eid"), F.col("opportunity_id").alias("_oid"))
    op = opportunities.select(F.col("id").alias("_opid"), F.col("niche_id"))
    j = sites.join(ev, sites.evaluation_id == F.col("_eid"), "left")
    j = j.join(op, F.col("_oid") == F.col("_opid"), "left").drop("_eid", "_oid", "_opid")
    return j.withColumn("project_slug", text.project_base("niche_id", "build_path", "id"))


def deployment_plan(targets: DataFrame, completed: str = "completed", host_suffix: str = ".pages.dev") -> DataFrame:
    """Per completed generation its project slug and canonical URL;
    other generations become REJECTED outcome rows (C4)."""
    ok = F.col("status") == completed
    return targets.select(
        F.col("id").alias("site_generation_id"),
        "project_slug",
        F.when(ok, F.concat(F.lit("https://"), F.col("project_slug"), F.lit(host_suffix))).alias("live_url"),
        F.when(ok, F.lit("COMPLETED")).otherwise(F.lit("REJECTED")).alias("outcome"),
        F.when(~ok, F.format_string("site generation status is %s, not completed", F.col("status"))).alias("message"),
    )
