"""Stage-level queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefleet.functions import text
from pagefleet.operators import ledger as L
from pagefleet.operators import scoring as S
from pagefleet.operators import telemetry as TM
from pagefleet.plans import stages as ST
from pagefleet.plans.candidate_queries import _CAND_CTE, _REASON_SQL, _SCORE_SQL, CAND_FIELDS, part_candidates
from pagefleet.plans.fleet_queries import _DEP_CTE, order_deployments
from pagefleet.plans.registry import register, slug_sql, table
from pagefleet.session import scratch_dir
from pagefleet.sources.files import read_ledger


def _catalog_source(sf_dir: str):
    def source(spark: SparkSession, seed: str) -> DataFrame:
        cands = part_candidates(spark, sf_dir)
        return cands.select(F.col("pos").cast("long").alias("pos"),
                            S.candidate_variant(cands, CAND_FIELDS).alias("candidate"))
    return source


@register(
    "scout_run",
    f"WITH {_CAND_CTE} SELECT niche_id, {_SCORE_SQL} AS arbitrage_score, 'pending' AS status "
    f"FROM cand WHERE ({_REASON_SQL}) IS NULL",
)
def scout_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full scout run (pool -> validate -> classify -> score -> keyed ledger
    append) over the part catalogue; returns the persisted opportunities."""
    ledger = scratch_dir(spark, "ledger")
    ST.register_candidate_source("catalog", _catalog_source(sf_dir))
    ST.run_scout(spark, ["catalog"], "", ledger, "driver-run")
    return read_ledger(spark, ledger, "arbitrage_opportunities").select("niche_id", "arbitrage_score", "status")


def customer_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    path = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("/builds/"), text.route_slug("c_name"), F.lit("-e1-s"),
                                                    F.col("c_custkey").cast("string")))
    return c.select(F.col("c_custkey").alias("id"), path.alias("build_path"))


@register(
    "deployment_sites",
    f"WITH {_DEP_CTE} SELECT d.id, d.site_generation_id, "
    f"CASE WHEN c.c_acctbal > 0 THEN '/builds/' || {slug_sql('c.c_name')} || '-e1-s' || CAST(c.c_custkey AS VARCHAR) "
    "END AS build_path FROM dep d LEFT JOIN customer c ON d.site_generation_id = c.c_custkey",
)
def deployment_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: deployment -> build path of its site generation (null-tolerant)."""
    out = TM.deployment_sites(order_deployments(spark, sf_dir), customer_sites(spark, sf_dir))
    return out.select("id", "site_generation_id", "build_path")


@register(
    "status_gate",
    "SELECT o_orderkey AS id, 'REJECTED' AS outcome, 'evaluation verdict is ' || "
    "CASE o_orderstatus WHEN 'F' THEN 'approved' ELSE 'rejected' END || ', not approved' AS message "
    "FROM orders WHERE o_orderstatus <> 'F'",
)
def status_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: approved evaluations pass; the rest become REJECTED outcome rows."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected").alias("verdict"))
    _, rejected = L.status_gate(o, "verdict", "approved", "evaluation verdict is {}, not approved")
    return rejected.select("id", "outcome", "message")


@register(
    "pending_first",
    "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 20",
)
def pending_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 pending rows (ordered by id)."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"))
    return L.pending_limit(o, "status", "pending", 20).select("id")
