"""Telemetry, dashboard, ledger and deployment queries over the driver tables.

Derivations shared by Spark and the oracles:

* events -> page telemetry: page ``/p/{k}`` from ``props.k``, deployment
  ``floor(k / 10)``, ``view`` = impression, ``click`` = click, ``purchase``
  value = revenue (cents).
* orders -> deployment rows: id = order key, status from the order status
  (F completed, O running, P failed), live URL for the two top priorities,
  created_at = order date, a trace for failed rows.
* orders ⟕ customer -> evaluations ⟕ opportunities; lineitem -> site
  generations (id = order key * 10 + line number).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagefleet.functions import scalar, text
from pagefleet.operators import dashboard as D
from pagefleet.operators import deploy as DP
from pagefleet.operators import explore as X
from pagefleet.operators import ledger as L
from pagefleet.operators import telemetry as TM
from pagefleet.plans.registry import register, slug_sql, table
from pagefleet.session import checkpointed, spread

# ---------------------------------------------------------------- derivations
_EV_CTE = """
ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events
),
pm AS (
  SELECT CAST(floor(k / 10) AS BIGINT) AS deployment_id, '/p/' || CAST(k AS VARCHAR) AS page_path, k,
         CAST(count_if(event_type = 'view') AS BIGINT) AS impressions,
         CAST(count_if(event_type = 'click') AS BIGINT) AS clicks,
         CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) END), 0)
              AS BIGINT) AS revenue_cents
  FROM ev GROUP BY 1, 2, 3
)"""

_CTR_SQL = "round(CASE WHEN impressions > 0 THEN clicks / impressions ELSE 0.0 END, 4)"
_RAW_CTR_SQL = "(CASE WHEN impressions > 0 THEN clicks / impressions ELSE 0.0 END)"

_DEP_CTE = """
dep AS (
  SELECT o_orderkey AS id, o_custkey AS site_generation_id,
         'site-' || CAST(o_custkey AS VARCHAR) AS project_slug,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH')
              THEN 'https://site-' || CAST(o_custkey AS VARCHAR) || '.pages.dev' END AS live_url,
         o_orderdate AS created_at, o_totalprice AS score,
         CASE WHEN o_orderstatus = 'P' THEN 'priority ' || o_orderpriority END AS log_trace
  FROM orders
)"""


def page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def page_metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9 over the events table (telemetry per deployment and page)."""
    ev = page_events(spark, sf_dir)
    revenue = F.round(F.col("value") * 100).cast("long")
    keys = [
        F.floor(F.col("k") / 10).cast("long").alias("deployment_id"),
        F.concat(F.lit("/p/"), F.col("k").cast("string")).alias("page_path"),
        F.col("k"),
    ]
    return TM.page_metrics(ev, keys, revenue=revenue)


def order_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    st = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("site_generation_id"),
        F.concat(F.lit("site-"), F.col("o_custkey").cast("string")).alias("project_slug"),
        F.when(st == "F", "completed").when(st == "O", "running").otherwise("failed").alias("status"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
               F.concat(F.lit("https://site-"), F.col("o_custkey").cast("string"), F.lit(".pages.dev")))
        .alias("live_url"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("score"),
        F.when(st == "P", F.concat(F.lit("priority "), F.col("o_orderpriority"))).alias("log_trace"),
    )


# ---------------------------------------------------------------- telemetry
@register(
    "page_metrics",
    f"WITH {_EV_CTE} SELECT deployment_id, page_path, impressions, clicks, revenue_cents, {_CTR_SQL} AS ctr FROM pm",
)
def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page events rolled up per deployment and page, with ctr."""
    return TM.with_ctr(page_metric_rows(spark, sf_dir)).drop("k")


_FLAG_CTE = f"""
fl AS (
  SELECT *, row_number() OVER (PARTITION BY deployment_id ORDER BY k) AS rn
  FROM pm WHERE impressions >= 15 AND {_RAW_CTR_SQL} < 0.8
)"""


def capped_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = TM.flag_underperformers(page_metric_rows(spark, sf_dir), min_impressions=15, max_ctr=0.8)
    return TM.cap_flagged_pages(flagged, "deployment_id", ["k"], max_pages=2)


@register(
    "flagged_pages",
    f"WITH {_EV_CTE}, {_FLAG_CTE} SELECT deployment_id, page_path, impressions, clicks, {_CTR_SQL} AS ctr "
    "FROM fl WHERE rn <= 2",
)
def flagged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Underperformers (impressions >= 15, ctr < 0.8), first two per deployment."""
    return TM.with_ctr(capped_flags(spark, sf_dir)).select(
        "deployment_id", "page_path", "impressions", "clicks", "ctr"
    )


@register(
    "flagged_counts",
    f"WITH {_EV_CTE}, {_FLAG_CTE} SELECT deployment_id, count(*) AS flagged FROM fl GROUP BY deployment_id",
)
def flagged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uncapped flagged count per deployment."""
    flagged = TM.flag_underperformers(page_metric_rows(spark, sf_dir), min_impressions=15, max_ctr=0.8)
    return TM.flagged_count(flagged, "deployment_id")


_REWRITE_CTE = """
meta AS (
  SELECT page_id AS site_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, url AS description
  FROM pages
),
ans AS (
  SELECT f.deployment_id AS site_id, f.k AS seq, (lb.quality = 1) AS ok,
         CASE WHEN lb.toxic = 1 THEN '' ELSE 'Best ' || f.page_path || ' picks' END AS title,
         'Fresh figures for ' || f.page_path AS description,
         [f.page_path, 'k' || CAST(f.k AS VARCHAR)] AS keywords
  FROM fl f JOIN labels lb ON lb.doc_id = f.k
  WHERE f.rn <= 2
),
per_site AS (
  SELECT site_id,
         arg_max(title, CASE WHEN title <> '' THEN seq END) AS new_title,
         arg_max(description, CASE WHEN description <> '' THEN seq END) AS new_description,
         arg_max(keywords, CASE WHEN len(keywords) > 0 THEN seq END) AS new_keywords,
         count(*) AS applied
  FROM ans WHERE ok GROUP BY site_id
)"""


def site_meta_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        F.col("page_id").alias("site_id"),
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        F.col("url").alias("description"),
    )


def rewrite_answers(spark: SparkSession, sf_dir: str, capped: DataFrame) -> DataFrame:
    """Rewrite answers for the capped flagged pages; labels decide ok / empty title."""
    labels = table(spark, sf_dir, "labels")
    j = capped.join(labels, capped.k == labels.doc_id, "inner")
    return j.select(
        F.col("deployment_id").alias("site_id"),
        F.col("k").alias("seq"),
        (F.col("quality") == 1).alias("ok"),
        F.when(F.col("toxic") == 1, F.lit("")).otherwise(
            F.concat(F.lit("Best "), F.col("page_path"), F.lit(" picks"))).alias("title"),
        F.concat(F.lit("Fresh figures for "), F.col("page_path")).alias("description"),
        F.array(F.col("page_path"), F.concat(F.lit("k"), F.col("k").cast("string"))).alias("keywords"),
    )


@register(
    "rewrites_applied",
    f"WITH {_EV_CTE}, {_FLAG_CTE}, {_REWRITE_CTE} "
    "SELECT m.site_id, coalesce(nullif(p.new_title, ''), m.title) AS title, "
    "coalesce(nullif(p.new_description, ''), m.description) AS description, "
    "array_to_string(p.new_keywords, ',') AS optimized_keywords, coalesce(p.applied > 0, false) AS optimized "
    "FROM meta m LEFT JOIN per_site p ON m.site_id = p.site_id",
)
def rewrites_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrites of each site's flagged pages applied to its meta; the last
    non-empty value wins."""
    flags = checkpointed(capped_flags(spark, sf_dir))  # read twice: events are scanned once
    capped = flags.select(F.col("deployment_id").alias("site_id"), F.col("k").alias("seq"))
    out = TM.apply_rewrites(site_meta_rows(spark, sf_dir), capped, rewrite_answers(spark, sf_dir, flags))
    return out.withColumn("optimized_keywords", F.array_join("optimized_keywords", ","))


@register(
    "optimization_outcomes",
    f"WITH {_EV_CTE}, {_FLAG_CTE}, {_REWRITE_CTE} "
    "SELECT f.deployment_id, f.page_path, "
    "CASE WHEN NOT coalesce(a.ok, false) THEN 'failed' "
    "     WHEN m.site_id IS NOT NULL THEN 'meta_rewrite' ELSE 'meta_unavailable' END AS action, "
    "CASE WHEN coalesce(a.ok, false) THEN 'COMPLETED' ELSE 'FAILED' END AS status, "
    "CASE WHEN coalesce(a.ok, false) AND a.title <> '' THEN 'title=''' || a.title || '''' "
    "     WHEN coalesce(a.ok, false) THEN 'no title returned' END AS detail "
    "FROM fl f LEFT JOIN ans a ON a.site_id = f.deployment_id AND a.seq = f.k "
    "LEFT JOIN meta m ON m.site_id = f.deployment_id WHERE f.rn <= 2",
)
def optimization_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per flagged page the action and status of its rewrite."""
    flags = checkpointed(capped_flags(spark, sf_dir))
    capped = flags.withColumn("site_id", F.col("deployment_id")).withColumn("seq", F.col("k"))
    out = TM.optimization_outcomes(capped, rewrite_answers(spark, sf_dir, flags), site_meta_rows(spark, sf_dir))
    return out.select("deployment_id", "page_path", "action", "status", "detail")


# ---------------------------------------------------------------- dashboard
@register(
    "traffic_scorecard",
    f"WITH {_EV_CTE}, {_DEP_CTE} SELECT round(s.rev / 100.0, 2) AS revenue_usd, s.imp AS impressions, "
    "s.clk AS clicks, round(CASE WHEN s.imp > 0 THEN s.clk / s.imp ELSE 0.0 END, 4) AS ctr, "
    "(SELECT CAST(count_if(status = 'completed') AS BIGINT) FROM dep) AS live_deployments, "
    "(SELECT count(*) FROM part) AS opportunities "
    "FROM (SELECT CAST(coalesce(sum(impressions), 0) AS BIGINT) AS imp, CAST(coalesce(sum(clicks), 0) AS BIGINT) AS clk, "
    "CAST(coalesce(sum(revenue_cents), 0) AS BIGINT) AS rev FROM pm) s",
)
def traffic_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue / traffic scorecard over all telemetry snapshots."""
    return D.traffic_scorecard(page_metric_rows(spark, sf_dir), order_deployments(spark, sf_dir),
                               table(spark, sf_dir, "part"))


_COUNT_TABLES = ["customer", "orders", "lineitem", "part", "supplier", "events"]


@register(
    "table_counts",
    " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS \"rows\" FROM {t}" for t in _COUNT_TABLES),
)
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of several tables."""
    return D.table_counts({t: table(spark, sf_dir, t) for t in _COUNT_TABLES})


@register("status_counts", f"WITH {_DEP_CTE} SELECT status, count(*) AS n FROM dep GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: deployments by status."""
    return D.counts_by_status(order_deployments(spark, sf_dir))


@register(
    "live_sites",
    f"WITH {_DEP_CTE} SELECT id AS deployment_id, project_slug, live_url, status FROM dep WHERE live_url IS NOT NULL",
)
def live_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deployments with a live URL."""
    return D.live_sites(order_deployments(spark, sf_dir))


@register("top_k", f"WITH {_DEP_CTE} SELECT id, score FROM dep ORDER BY score DESC, id ASC LIMIT 20")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest-scoring rows."""
    return D.top_k(order_deployments(spark, sf_dir), 20, "score").select("id", "score")


@register("recent_k", f"WITH {_DEP_CTE} SELECT id, created_at FROM dep ORDER BY created_at DESC, id DESC LIMIT 20")
def recent_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 newest rows."""
    return D.recent(order_deployments(spark, sf_dir), 20).select("id", "created_at")


def order_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("opportunity_id"),
                    F.col("o_orderdate").alias("created_at"))


def customer_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("niche_id"))


@register(
    "eval_listing",
    "SELECT o.o_orderkey AS id, coalesce(c.c_name, '-') AS niche_id, o.o_orderdate AS created_at "
    "FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey "
    "ORDER BY o.o_orderdate DESC, o.o_orderkey DESC LIMIT 20",
)
def eval_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest evaluations with their opportunity's niche ('-' when missing)."""
    out = D.evaluation_listing(order_evaluations(spark, sf_dir), customer_opportunities(spark, sf_dir), 20)
    return out.select("id", "niche_id", "created_at")


_ERR_BRANCHES = [
    ("scout_job", "SELECT o_orderkey AS id, 'priority ' || o_orderpriority AS trace FROM orders "
                  "WHERE o_orderstatus = 'P'"),
    ("site_generation", "SELECT p_partkey AS id, 'build of ' || p_name AS trace FROM part WHERE p_size > 45"),
    ("deployment", "SELECT event_id AS id, props AS trace FROM events WHERE event_type = 'error'"),
    ("optimization", "SELECT doc_id AS id, 'toxic' AS trace FROM labels WHERE toxic = 1"),
]


@register(
    "errors_union",
    "SELECT kind, id, trace FROM ("
    + " UNION ALL ".join(
        f"SELECT * FROM (SELECT {i} AS ord, '{k}' AS kind, CAST(id AS BIGINT) AS id, trace FROM ({q}) "
        f"ORDER BY id LIMIT 20)" for i, (k, q) in enumerate(_ERR_BRANCHES)
    )
    + ") ORDER BY ord, id LIMIT 20",
)
def errors_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed rows of four tables as kind, id, trace (limit per table, then overall)."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ok").alias("status"),
        F.concat(F.lit("priority "), F.col("o_orderpriority")).alias("trace"),
    )
    li = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") > 45, "failed").otherwise("ok").alias("status"),
        F.concat(F.lit("build of "), F.col("p_name")).alias("trace"),
    )
    ev = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"),
        F.col("props").alias("trace"),
    )
    lb = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("toxic") == 1, "failed").otherwise("ok").alias("status"),
        F.lit("toxic").alias("trace"),
    )
    branches = [("scout_job", o, "trace"), ("site_generation", li, "trace"),
                ("deployment", ev, "trace"), ("optimization", lb, "trace")]
    return D.latest_errors(branches, limit=20)


# ---------------------------------------------------------------- ledger
@register(
    "latest_state",
    "SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM ("
    "SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn "
    "FROM orders) WHERE rn = 1",
)
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the current row per key (newest date, then highest sequence)."""
    o = table(spark, sf_dir, "orders")
    out = L.latest_state(o, "o_custkey", ["o_orderdate", "o_orderkey"])
    return out.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")


def order_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    st = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("kind"),
        F.when(st == "O", "running").when(st == "P", "queued").otherwise("succeeded").alias("status"),
    )


@register(
    "orphan_jobs",
    "SELECT id, action, new_status, error FROM (SELECT o_orderkey AS id, o_orderpriority AS kind, "
    "CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'queued' ELSE 'succeeded' END AS status FROM orders) j, "
    "LATERAL (SELECT CASE WHEN j.status = 'running' THEN 'fail' "
    "  WHEN j.kind IN ('1-URGENT', '2-HIGH') THEN 'requeue' ELSE 'none' END AS action, "
    "  CASE WHEN j.status = 'running' THEN 'failed' ELSE j.status END AS new_status, "
    "  CASE WHEN j.status = 'running' THEN 'interrupted by restart' END AS error) "
    "WHERE j.status IN ('queued', 'running')",
)
def orphan_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphaned jobs after a restart: running ones fail, queued ones of a
    known kind are requeued."""
    out = L.reconcile_jobs(order_jobs(spark, sf_dir), ["1-URGENT", "2-HIGH"])
    return out.select("id", "action", "new_status", "error")


@register(
    "orphan_counts",
    "SELECT CAST(count_if(o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AS BIGINT) AS requeued, "
    "CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS interrupted FROM orders",
)
def orphan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requeued / interrupted totals."""
    return L.reconcile_counts(L.reconcile_jobs(order_jobs(spark, sf_dir), ["1-URGENT", "2-HIGH"]))


_EVOLVED = T.StructType([
    T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType()),
    T.StructField("s_nationkey", T.IntegerType()), T.StructField("s_acctbal", T.DoubleType()),
    T.StructField("s_phone", T.StringType()), T.StructField("s_rating", T.DoubleType()),
])


@register(
    "schema_evolved",
    "SELECT *, CAST(NULL AS VARCHAR) AS s_phone, CAST(NULL AS DOUBLE) AS s_rating FROM supplier",
)
def schema_evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: an older table reconciled with a newer schema (missing columns added
    as typed nulls, existing ones untouched; applied twice = once)."""
    once = L.evolve_schema(table(spark, sf_dir, "supplier"), _EVOLVED)
    return L.evolve_schema(once, _EVOLVED)


def key_half_sql(half: int, *parts: str) -> str:
    """DuckDB spelling of ``key_halves``: a signed 64-bit half of the SHA-256 of the parts with their lengths."""
    named = " || ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts)
    digits = f"substr(sha256({named}), {1 + 16 * half}, 16)"
    number = f"('0x' || {digits})::UBIGINT::HUGEINT"
    return f"(CASE WHEN {number} > 9223372036854775807 THEN {number} - 18446744073709551616 ELSE {number} END)::BIGINT"


@register(
    "keys_assigned",
    f"""SELECT o_orderkey, o_custkey, {key_half_sql(0, "'run-1'", "o_orderkey::VARCHAR")} AS id,
    {key_half_sql(1, "'run-1'", "o_orderkey::VARCHAR")} AS id_low FROM orders""",
)
def keys_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deterministic 128-bit surrogate keys from run id and natural key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return L.assign_keys(o, "run-1", ["o_orderkey"])


@register(
    "key_audit",
    "SELECT (o_custkey % 97)::BIGINT AS id, count(DISTINCT o_orderkey) AS keys FROM orders GROUP BY 1 "
    "HAVING count(DISTINCT o_orderkey) > 1",
)
def key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the audit finds every id that stands for several keys (here ids of 97 values)."""
    o = table(spark, sf_dir, "orders")
    return L.audit_keys(o.select((F.col("o_custkey") % 97).alias("id"), F.col("o_orderkey").alias("id_low")))


# ---------------------------------------------------------------- deployments
def lineitem_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spread(table(spark, sf_dir, "lineitem"))
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("evaluation_id"),
        F.when(F.col("l_linestatus") == "F", "completed").otherwise("running").alias("status"),
        F.lit(None).cast("string").alias("build_path"),
    )


_CHAIN_CTE = f"""
chain AS (
  SELECT l.l_orderkey * 10 + l.l_linenumber AS id,
         CASE WHEN l.l_linestatus = 'F' THEN 'completed' ELSE 'running' END AS status,
         c.c_name AS niche_id
  FROM lineitem l
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
),
slugged AS (
  SELECT *, CASE WHEN niche_id IS NOT NULL AND niche_id <> ''
                 THEN coalesce(nullif(trim(substr({slug_sql('niche_id')}, 1, 58), '-'), ''), 'site')
                 ELSE 'site-' || CAST(id AS VARCHAR) END AS project_slug
  FROM chain
)"""


@register("target_chain", f"WITH {_CHAIN_CTE} SELECT id, niche_id, project_slug FROM slugged")
def target_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation -> evaluation -> opportunity, with the project slug."""
    out = DP.resolve_targets(lineitem_sites(spark, sf_dir), order_evaluations(spark, sf_dir),
                             customer_opportunities(spark, sf_dir))
    return out.select("id", "niche_id", "project_slug")


@register(
    "deployment_plan",
    f"WITH {_CHAIN_CTE} SELECT id AS site_generation_id, project_slug, "
    "CASE WHEN status = 'completed' THEN 'https://' || project_slug || '.pages.dev' END AS live_url, "
    "CASE WHEN status = 'completed' THEN 'COMPLETED' ELSE 'REJECTED' END AS outcome, "
    "CASE WHEN status <> 'completed' THEN 'site generation status is ' || status || ', not completed' END AS message "
    "FROM slugged",
)
def deployment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deployment records for completed generations, rejections for the rest."""
    targets = DP.resolve_targets(lineitem_sites(spark, sf_dir), order_evaluations(spark, sf_dir),
                                 customer_opportunities(spark, sf_dir))
    return DP.deployment_plan(targets)


# ---------------------------------------------------------------- explore / functions
_PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@register(
    "search_rows",
    "SELECT * FROM part WHERE " + " OR ".join(
        f"coalesce(contains(lower(CAST({c} AS VARCHAR)), 'blue'), false)" for c in _PART_COLS),
)
def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the (trimmed, case-folded) needle in any cell."""
    return X.search_rows(table(spark, sf_dir, "part"), "  Blue ")


@register(
    "search_count",
    "SELECT count(*) AS results FROM part WHERE " + " OR ".join(
        f"coalesce(contains(lower(CAST({c} AS VARCHAR)), 'brand#1'), false)" for c in _PART_COLS),
)
def search_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result count of a search."""
    return X.search_count(table(spark, sf_dir, "part"), "BRAND#1")


@register("sort_rows", "SELECT * FROM part ORDER BY p_retailprice DESC")
def sort_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows ordered by a numeric column, descending."""
    return X.sort_rows(table(spark, sf_dir, "part"), "p_retailprice", ascending=False)


_TITLE_SQL = ("array_to_string(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|[^\\p{{L}}]+)', 1), "
              "lambda r: upper(r[1]) || lower(r[2:])), '')")


@register(
    "slugs_titles",
    "SELECT p_partkey, " + slug_sql("p_name") + " AS route_slug, "
    "coalesce(nullif(" + slug_sql("p_brand") + ", ''), 'site') AS site_slug, "
    "coalesce(nullif(trim(substr(" + slug_sql("p_type || ' ' || p_name || ' ' || p_brand") + ", 1, 12), '-'), ''), "
    "'site') AS project_slug, "
    "CASE WHEN p_name IS NULL OR p_name = '' THEN 'Data Site' ELSE "
    + _TITLE_SQL.format(x="replace(replace(p_name || '_' || p_brand, '_', ' '), '-', ' ')")
    + " END AS title FROM part",
)
def slugs_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """route/site/project slugs and titles of part rows."""
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        text.route_slug("p_name").alias("route_slug"),
        text.site_slug("p_brand").alias("site_slug"),
        text.project_slug(F.concat_ws(" ", "p_type", "p_name", "p_brand"), max_len=12).alias("project_slug"),
        text.title_from(F.concat(F.col("p_name"), F.lit("_"), F.col("p_brand"))).alias("title"),
    )


_CALC_INPUTS = [("l_orderkey", 1.0), ("l_partkey", 1.0), ("l_suppkey", 1.0), ("l_linenumber", 1.0),
                ("l_quantity", 1.0)]


@register(
    "calculator_values",
    "SELECT l_orderkey, l_linenumber, 0.0 + CAST(l_orderkey AS DOUBLE) * 1.0 + CAST(l_partkey AS DOUBLE) * 1.0 "
    "+ CAST(l_suppkey AS DOUBLE) * 1.0 + CAST(l_linenumber AS DOUBLE) * 1.0 + l_quantity * 1.0 AS value FROM lineitem",
)
def calculator_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I16: the calculator's weighted sum over the first five numeric columns, every row."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", scalar.calculator_value(li, _CALC_INPUTS).alias("value"))


@register(
    "json_safe_cells",
    "SELECT event_id, CASE WHEN strftime(ts, '%f') = '000000' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') "
    "ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts, "
    "CASE WHEN isnan(value) OR isinf(value) THEN NULL ELSE value END AS value, event_type FROM events",
)
def json_safe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells coerced for strict JSON (ISO timestamps, non-finite -> null)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "value", "event_type")
    return scalar.json_safe_frame(ev)
