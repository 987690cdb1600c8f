"""Details of single operators over the driver tables: every branch, order and text of C12, G5, G9, H2, I5, I6, I15-I19, I25, I26, I29, K3."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefleet.functions import scalar, text
from pagefleet.operators import dashboard as D
from pagefleet.operators import explore as X
from pagefleet.operators import ledger as L
from pagefleet.operators import pages as P
from pagefleet.operators import routes as R
from pagefleet.operators import verdicts as V
from pagefleet.operators.numbering import running_count
from pagefleet.plans.fleet_queries import _TITLE_SQL, order_deployments
from pagefleet.plans.registry import register, slug_sql, table
from pagefleet.session import scratch_dir
from pagefleet.sources import files
from pagefleet.sources.files import read_ledger

# ---------------------------------------------------------------- H2: every branch
_FEW = [
    ("scout_job", "orders", "o_orderkey", "o_orderkey % 4001 = 1", "'priority ' || o_orderpriority"),
    ("site_generation", "part", "p_partkey", "p_partkey % 401 = 1", "'build of ' || p_name"),
    ("deployment", "customer", "c_custkey", "c_custkey % 301 = 1", "c_name"),
    ("optimization", "supplier", "s_suppkey", "s_suppkey % 21 = 1", "s_name"),
]


@register(
    "errors_branches",
    "SELECT kind, id, trace FROM (" + " UNION ALL ".join(
        f"SELECT * FROM (SELECT {i} AS ord, '{kind}' AS kind, CAST({key} AS BIGINT) AS id, {trace} AS trace FROM {t} "
        f"WHERE {failed} ORDER BY id LIMIT 20)" for i, (kind, t, key, failed, trace) in enumerate(_FEW))
    + ") ORDER BY ord, id LIMIT 20",
)
def errors_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few failures in each of four tables, so that the latest errors hold all kinds."""
    return D.latest_errors([
        (kind, table(spark, sf_dir, t).select(F.col(key).cast("long").alias("id"), F.when(F.expr(failed), "failed").otherwise(
            "ok").alias("status"), F.expr(trace).alias("trace")), "trace") for kind, t, key, failed, trace in _FEW])


# ---------------------------------------------------------------- G9, G5: orders and caps
@register(
    "sort_rows_ranked",
    "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey DESC) AS by_number, "
    "row_number() OVER (ORDER BY CAST(p_partkey AS VARCHAR)) AS by_text FROM part",
)
def sort_rows_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each row in the sorted output; numbers sort as numbers, texts as texts."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("name"))

    def placed(rows: DataFrame, out: str) -> DataFrame:
        rows = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_all", F.lit(0))
        return running_count(rows, "_all", [F.col("_at").asc()], F.lit(1), out).select("p_partkey", out)

    numbers = placed(X.sort_rows(part, "p_partkey", ascending=False), "by_number")
    return numbers.join(placed(X.sort_rows(part, "name"), "by_text"), "p_partkey")


_SIX = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@register("row_cap", f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY {_SIX} LIMIT 500")
def row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 rows of a dataset in a given order."""
    capped = R.cap_rows(table(spark, sf_dir, "lineitem"), 500, _SIX.split(", "))
    return capped.select("l_orderkey", "l_linenumber", "l_partkey")


# ---------------------------------------------------------------- C12 -> I15 -> I16, I17, I18
@register(
    "calculator_run",
    "SELECT l_orderkey, l_linenumber, l_partkey, 0.0 + CAST(l_orderkey AS DOUBLE) + CAST(l_partkey AS DOUBLE) + "
    "CAST(l_suppkey AS DOUBLE) + CAST(l_linenumber AS DOUBLE) + l_quantity AS value FROM lineitem",
)
def calculator_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calculator that a dataset's own profile describes, evaluated on every row of it."""
    li = table(spark, sf_dir, "lineitem")
    catalogue, _, _ = files.profile_dataset(li)
    # One block with at most five inputs: plan parameters.
    block = P.calculator_blocks(catalogue.withColumn("dataset", F.lit("lineitem"))).first()["calculator"]
    inputs = [(i["key"], float(i["weight"])) for i in block["inputs"]]
    return li.select("l_orderkey", "l_linenumber", "l_partkey", scalar.calculator_value(li, inputs, float(block["base"])).alias("value"))


_BASE_SQL = "'https://' || coalesce(nullif({slug}, ''), 'site') || '.pages.dev'"


@register(
    "calculator_json_ld",
    "SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN json_object('@context', 'https://schema.org', '@type', 'WebApplication', "
    "'name', p_name, 'description', CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_type END, 'applicationCategory', "
    f"'BusinessApplication', 'url', {_BASE_SQL.format(slug=slug_sql('p_brand'))}) "
    "ELSE json_object('@context', 'https://schema.org', '@type', 'WebApplication', 'name', p_name, 'description', "
    "CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_type END, 'applicationCategory', 'BusinessApplication') END AS VARCHAR) AS json_ld "
    "FROM part",
)
def calculator_json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The WebApplication data of calculator sites, with and without a base and a description."""
    p = table(spark, sf_dir, "part")
    base = text.canonical_base(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")))
    description = F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.col("p_type"))
    return p.select("p_partkey", P.json_ld_index(F.col("p_name"), description, base, "WebApplication").alias("json_ld"))


@register(
    "site_meta_documents",
    f"""SELECT c_custkey, CAST(json_object('niche_id', c_name, 'title', {_TITLE_SQL.format(x="replace(replace(c_name, '_', ' '), '-', ' ')")},
'description', CASE WHEN c_custkey % 2 = 0 THEN 'https://data/' || c_custkey ELSE '' END, 'template_type', 'directory',
'monetization_pattern', CASE WHEN c_custkey % 3 = 0 THEN 'local_lead_generation' ELSE 'premium_cpc' END,
'canonical_base', {_BASE_SQL.format(slug=slug_sql('c_name'))}, 'route_count', coalesce(n, 0),
'seo', json_object('route_pattern', '/' || c_mktsegment, 'high_volume_columns', [c_mktsegment], 'sample_routes', []::VARCHAR[]),
'columns', ['o_orderkey', 'o_totalprice'], 'lead_gen', c_custkey % 3 = 0, 'lead_webhook', '', 'confidence', 0.5::DOUBLE,
'calculator', NULL) AS VARCHAR) AS meta, true AS stamped
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
)
def site_meta_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The meta document of a site for every customer, without its time, which is checked to be set."""
    key = F.col("c_custkey")
    sites = table(spark, sf_dir, "customer").select(
        key.alias("site"), F.col("c_name").alias("niche_id"),
        F.when(key % 2 == 0, F.concat(F.lit("https://data/"), key)).alias("target_dataset_url"), F.lit("directory").alias("template_type"),
        F.when(key % 3 == 0, "local_lead_generation").otherwise("premium_cpc").alias("monetization_pattern"),
        F.concat(F.lit("/"), F.col("c_mktsegment")).alias("seo_route_pattern"), F.array("c_mktsegment").alias("seo_high_volume_columns"),
        F.lit(None).cast("array<string>").alias("seo_sample_routes"), F.lit(0.5).alias("confidence"),
        F.array(F.lit("o_orderkey"), F.lit("o_totalprice")).alias("columns"), F.lit(None).cast("string").alias("calculator"))
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("site")).agg(F.count("*").alias("route_count"))
    meta = P.site_meta(sites, counts)
    told = F.col("meta").dropFields("generated_at")
    return meta.select(F.col("site").alias("c_custkey"), scalar.strict_json(told).alias("meta"),
                       (F.to_timestamp("meta.generated_at") > F.current_timestamp() - F.expr("INTERVAL 1 DAY")).alias("stamped"))


# ---------------------------------------------------------------- I5, I6, I19
_PATH_SQL = "CASE WHEN o_orderkey % 4 < 3 THEN '/builds/' || lower(o_orderpriority) || '-e7-s' || o_orderkey || '/' END"
_NICHE_SQL = "CASE o_orderkey % 4 WHEN 0 THEN 'Niche ' || o_orderpriority WHEN 1 THEN '' END"


def _cut(slug: str) -> str:
    return f"coalesce(nullif(trim(substr({slug}, 1, 58), '-'), ''), 'site')"


@register(
    "build_names",
    f"""SELECT o_orderkey, coalesce(nullif({slug_sql(f"coalesce(nullif({_NICHE_SQL}, ''), 'evaluation-' || o_custkey)")}, ''), 'site')
 || '-e' || o_custkey || '-s' || o_orderkey AS build_name,
CASE WHEN coalesce({_NICHE_SQL}, '') <> '' THEN {_cut(slug_sql(_NICHE_SQL))}
     WHEN {_PATH_SQL} IS NOT NULL THEN {_cut(slug_sql("lower(o_orderpriority)"))} ELSE 'site-' || o_orderkey END AS project,
CASE WHEN o_orderkey % 3 = 0 THEN 'https://site-' || o_custkey || '.pages.dev' ELSE '' END AS pages_url FROM orders""",
)
def build_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build names with and without a niche, all three project bases, the URL in a deploy log."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    niche = F.when(k % 4 == 0, F.concat(F.lit("Niche "), F.col("o_orderpriority"))).when(k % 4 == 1, F.lit(""))
    path = F.when(k % 4 < 3, F.concat(F.lit("/builds/"), F.lower("o_orderpriority"), F.lit("-e7-s"), k, F.lit("/")))
    url = F.concat(F.lit("https://site-"), F.col("o_custkey"), F.lit(".pages.dev"))
    log = F.concat(F.lit("Uploading 13 files\n"), F.when(k % 3 == 0, F.concat(F.lit("Deployed to "), url, F.lit(" in 2 s"))).otherwise(
        F.lit("failed: https://example.org")))
    return o.select("o_orderkey", text.build_name(niche, F.col("o_custkey"), k).alias("build_name"),
                    text.project_base(niche, path, k).alias("project"), text.extract_pages_url(log).alias("pages_url"))


# ---------------------------------------------------------------- I25, I26
@register(
    "error_summaries",
    "SELECT p_partkey, nullif(array_to_string(list_filter([CASE WHEN p_size > 30 THEN 'p_size: too large (' || p_size || ')' END, "
    "CASE WHEN contains(p_name, 'blue') THEN 'p_name: blue' END, CASE WHEN p_retailprice < 1000 THEN 'p_retailprice: too small' END], "
    "lambda x: x IS NOT NULL), '; '), '') AS summary FROM part",
)
def error_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The problems of every part in one line; none without any."""
    found = F.filter(F.array(
        F.when(F.col("p_size") > 30, F.format_string("p_size: too large (%s)", "p_size")),
        F.when(F.contains("p_name", F.lit("blue")), F.lit("p_name: blue")),
        F.when(F.col("p_retailprice") < 1000, F.lit("p_retailprice: too small"))), lambda x: x.isNotNull())
    return table(spark, sf_dir, "part").select("p_partkey", text.error_summary(found).alias("summary"))


@register(
    "json_lists",
    "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CAST(to_json(string_split(p_name, ' ')) AS VARCHAR) ELSE '[]' END AS encoded, "
    "CASE p_partkey % 4 WHEN 0 THEN len(string_split(p_name, ' ')) WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE 0 END::INT AS n FROM part",
)
def json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text lists there and back; null, empty and broken texts are empty lists."""
    k = F.col("p_partkey") % 4
    stored = F.when(k == 0, scalar.json_list_encode(F.split("p_name", " "))).when(k == 1, F.lit("")).when(k == 2, F.lit("{not json"))
    p = table(spark, sf_dir, "part").select("p_partkey", scalar.json_list_decode(stored).alias("items"))
    return p.select("p_partkey", scalar.json_list_encode("items").alias("encoded"), F.size("items").alias("n"))


# ---------------------------------------------------------------- I29, K3
@register("stamped_rows", "SELECT count(*) AS n, count(*) AS stamped FROM orders")
def stamped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that a run appends has a time of this run."""
    ledger = scratch_dir(spark, "ledger")
    rows = order_deployments(spark, sf_dir).drop("created_at").withColumn("created_at", scalar.stamp()).withColumn("updated_at", scalar.stamp())
    L.append_ledger(rows, ledger, "deployments")
    now = F.current_timestamp()
    fresh = (F.col("created_at") <= now) & (F.col("created_at") > now - F.expr("INTERVAL 1 DAY")) & (F.col("updated_at") == F.col("created_at"))
    return read_ledger(spark, ledger, "deployments").agg(F.count("*").alias("n"), F.count_if(fresh).alias("stamped"))


def _by_size(requests: pd.DataFrame) -> pd.DataFrame:
    """A scorer: confident of small parts; cannot judge every 50th."""
    sizes = [json.loads(p)["size"] for p in requests["params"]]
    bodies = [json.dumps({"error": "no idea"} if s == 50 else {"result": {
        "monetization_pattern": "premium_cpc", "architectural_layout": "directory", "confidence": 0.75 if s < 20 else 0.25}})
        for s in sizes]
    return pd.DataFrame({"request_id": requests["request_id"], "body": bodies})


@register(
    "scorer_verdicts",
    "SELECT p_partkey AS opportunity_id, CASE WHEN p_size = 50 THEN 'FAILED' WHEN p_size < 20 THEN 'APPROVED' ELSE 'REJECTED' END AS status, "
    "CASE WHEN p_size = 50 THEN NULL WHEN p_size < 20 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS confidence FROM part",
)
def scorer_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of a scorer that runs inside the tasks."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "opportunity_id")
    answers = V.score_with(part, _by_size, "opportunity_id", F.struct(F.col("p_size").alias("size")), "evaluate")
    work = part.select("opportunity_id", V.request_id("evaluate", "opportunity_id").alias("request_id"))
    return V.apply_verdicts(work, answers).select("opportunity_id", "status", "confidence")
