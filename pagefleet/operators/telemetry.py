"""Page telemetry: roll-ups, click-through, flags, caps and meta rewrites.

E9 page_metrics, I9 with_ctr, C5 flag_underperformers, F2 cap_flagged_pages,
D3 deployment_sites, D7 apply_rewrites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefleet import schemas
from pagefleet.functions import scalar
from pagefleet.operators.numbering import first_per_group


def page_metrics(
    events: DataFrame,
    keys: list[str | Column],
    event_type: str = "event_type",
    revenue: Column | None = None,
    impression: str = "view",
    click: str = "click",
    purchase: str = "purchase",
) -> DataFrame:
    """Raw page events -> ``impressions, clicks, revenue_cents`` per key.

    One partial+final hash aggregate: a hot page or deployment is combined
    map-side before the shuffle. ``revenue`` is the cents of one purchase.
    """
    et = F.col(event_type)
    rev = revenue if revenue is not None else F.lit(0)
    return events.groupBy(*keys).agg(
        F.count_if(et == impression).alias("impressions"),
        F.count_if(et == click).alias("clicks"),
        F.coalesce(F.sum(F.when(et == purchase, rev.cast("long"))), F.lit(0).cast("long")).alias("revenue_cents"),
    )


def with_ctr(metrics: DataFrame, digits: int | None = 4) -> DataFrame:
    """Add ``ctr`` = clicks / impressions (0.0 without impressions)."""
    return metrics.withColumn("ctr", scalar.ctr("clicks", "impressions", digits))


def flag_underperformers(
    metrics: DataFrame, min_impressions: int = schemas.MIN_IMPRESSIONS, max_ctr: float = schemas.MAX_CTR
) -> DataFrame:
    """``impressions >= min_impressions AND ctr < max_ctr`` (unrounded ctr)."""
    ratio = scalar.ctr("clicks", "impressions")
    return metrics.filter((F.col("impressions") >= min_impressions) & (ratio < max_ctr))


def cap_flagged_pages(
    flagged: DataFrame, partition: str, order_by: list[str], max_pages: int | None = None
) -> DataFrame:
    """the first ``max_pages`` flagged pages per deployment in source order; all without a cap.

    Any number of pages: see ``first_per_group``.
    """
    if max_pages is None:
        return flagged
    return first_per_group(flagged, partition, [F.col(c).asc() for c in order_by], max_pages)


def flagged_count(flagged: DataFrame, partition: str) -> DataFrame:
    """The uncapped flagged count per deployment (reported alongside F2)."""
    return flagged.groupBy(partition).agg(F.count(F.lit(1)).alias("flagged"))


def deployment_sites(deployments: DataFrame, sites: DataFrame) -> DataFrame:
    """D3: deployment -> build path of its site generation; tolerant of a null
    FK or a missing generation (both give a null build path)."""
    s = sites.select(F.col("id").alias("_sid"), F.col("build_path"))
    return deployments.join(s, deployments.site_generation_id == F.col("_sid"), "left").drop("_sid")


def apply_rewrites(meta: DataFrame, flagged: DataFrame, answers: DataFrame, site: str = "site_id",
                   seq: str = "seq", key: list[str] | None = None) -> DataFrame:
    """Site meta ⟕ rewrite answers of its flagged pages.

    Several flagged pages of one site overwrite the site document in order:
    the last non-empty title / description / keyword list wins (Q9);
    ``optimized`` is true when any answer was applied. Sites without an answer
    keep their meta. ``answers``: ``site_id, seq, ok, title, description,
    keywords``; ``meta``: ``site_id, title, description``. ``key`` names the
    columns that identify a flagged page where (site, seq) doesn't: two
    deployments of one site repeat it, (deployment, page) is unique.
    """
    key = key or [site, seq]
    ok = answers.filter(F.col("ok"))
    per_site = ok.join(flagged.select(*key).distinct(), key, "left_semi").groupBy(site).agg(
        F.max_by("title", F.when(F.col("title") != "", F.col(seq))).alias("new_title"),
        F.max_by("description", F.when(F.col("description") != "", F.col(seq))).alias("new_description"),
        F.max_by("keywords", F.when(F.size("keywords") > 0, F.col(seq))).alias("new_keywords"),
        F.count(F.lit(1)).alias("applied"),
    )
    j = meta.join(per_site, site, "left")
    return j.select(
        site,
        F.coalesce(F.nullif("new_title", F.lit("")), F.col("title")).alias("title"),
        F.coalesce(F.nullif("new_description", F.lit("")), F.col("description")).alias("description"),
        F.transform("new_keywords", lambda k: k.cast("string")).alias("optimized_keywords"),
        F.coalesce(F.col("applied") > 0, F.lit(False)).alias("optimized"),
    )


def quoted(c: Column) -> Column:
    """Text in single quotes, or in double quotes where it holds single ones only; backslashes are doubled."""
    inner = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(inner, F.lit("'"), F.lit("\\'")), F.lit("'")))


def optimization_outcomes(capped: DataFrame, answers: DataFrame, meta: DataFrame, site: str = "site_id",
                          seq: str = "seq", key: list[str] | None = None) -> DataFrame:
    """Per flagged page outcome: ``meta_rewrite`` / ``meta_unavailable`` when an
    answer exists (COMPLETED), ``failed`` (FAILED) otherwise, with the answer's
    ``error`` as detail where ``answers`` has that column. ``key`` as in
    ``apply_rewrites``."""
    key = key or [site, seq]
    problem = F.col("error") if "error" in answers.columns else F.lit(None).cast("string")
    a = answers.select(*key, F.col("ok").alias("_ok"), F.col("title").alias("_title"), problem.alias("_error"))
    m = meta.select(site, F.lit(True).alias("_has_meta"))
    j = capped.join(a, key, "left").join(m, site, "left")
    answered = F.coalesce(F.col("_ok"), F.lit(False))
    return j.select(
        *capped.columns,
        F.when(~answered, F.lit("failed"))
        .when(F.coalesce(F.col("_has_meta"), F.lit(False)), F.lit("meta_rewrite"))
        .otherwise(F.lit("meta_unavailable")).alias("action"),
        F.when(answered, F.lit("COMPLETED")).otherwise(F.lit("FAILED")).alias("status"),
        F.when(answered & (F.col("_title") != ""), F.concat(F.lit("title="), quoted(F.col("_title"))))
        .when(answered, F.lit("no title returned")).otherwise(F.col("_error")).alias("detail"),
    )
