"""Site documents over the driver tables.

One site per region: the customers of a region (customer ⋈ nation ⋈ region)
are routed by (nation, segment); the site's niche id is
``lower(r_name) || '_customers'``, its canonical base follows from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefleet.functions import text
from pagefleet.operators import pages as P
from pagefleet.operators import routes as R
from pagefleet.plans.registry import register, slug_sql, table
from pagefleet.session import checkpointed, scratch_dir
from pagefleet.sinks import writers as W
from pagefleet.sinks.containers import document_index, read_document, write_documents
from pagefleet.sources import files

_TITLE_SQL = ("array_to_string(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|[^\\p{{L}}]+)', 1), "
              "lambda r: upper(r[1]) || lower(r[2:])), '')")

_SITE_CTE = f"""
ds AS (
  SELECT c.c_custkey, c.c_name, n.n_name, c.c_mktsegment, c.c_acctbal, lower(r.r_name) || '_customers' AS site
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
),
sites AS (
  SELECT site, 'https://' || coalesce(nullif({slug_sql('site')}, ''), 'site') || '.pages.dev' AS base,
         {_TITLE_SQL.format(x="replace(replace(site, '_', ' '), '-', ' ')")} AS niche
  FROM (SELECT lower(r_name) || '_customers' AS site FROM region)
),
g AS (
  SELECT site, n_name, c_mktsegment, count(*) AS row_count
  FROM ds GROUP BY site, n_name, c_mktsegment
),
rt AS (
  SELECT g.site, '/' || {slug_sql('n_name')} || '/' || {slug_sql('c_mktsegment')} AS path, n_name, c_mktsegment,
         n_name || ' · ' || c_mktsegment || ' — ' || s.niche AS title,
         s.niche || ': ' || n_name || ' · ' || c_mktsegment || '. ' || CAST(row_count AS VARCHAR)
           || ' matching record(s).' AS description,
         row_count, s.base
  FROM g JOIN sites s ON g.site = s.site
)"""


def region_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")  # 25 rows by definition
    r = table(spark, sf_dir, "region")  # 5 rows by definition
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey)
    return j.select("c_custkey", "c_name", "n_name", "c_mktsegment", "c_acctbal",
                    F.concat(F.lower("r_name"), F.lit("_customers")).alias("site"))


def region_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site per region (read from the 5-row region table, not from the
    customer rows, so every use of the site list is a tiny scan)."""
    sites = table(spark, sf_dir, "region").select(F.concat(F.lower("r_name"), F.lit("_customers")).alias("site"))
    return sites.select(
        "site",
        text.canonical_base("site").alias("base"),
        text.title_from("site").alias("niche"),
        F.lit("directory").alias("template_type"),
    )


def region_routes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ds = region_dataset(spark, sf_dir)
    sites = region_sites(spark, sf_dir)
    routes = R.build_routes(ds, ["n_name", "c_mktsegment"], None, max_routes=None,
                            order_by=["c_custkey"], keep_keys=True, site="site")
    # Titles carry the per-site niche: attach it after grouping (one row per site).
    label = text.route_label([F.col("k0"), F.col("k1")])
    routes = routes.join(sites.select("site", "niche"), "site").withColumns({
        "title": text.route_title(label, F.col("niche")),
        "description": text.route_description(label, F.col("row_count"), F.col("niche")),
    }).drop("niche")
    # Pages, sitemaps and links all read the route table: materialise it once
    # (route rows, reliable checkpoint) instead of re-deriving it per use.
    return ds, sites, checkpointed(routes)


@register(
    "region_routes",
    f"WITH {_SITE_CTE} SELECT site, path, title, description, row_count FROM rt",
)
def region_routes_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 over many sites in one job: per-site routes, titles from the site niche."""
    _, _, routes = region_routes(spark, sf_dir)
    return routes.select("site", "path", "title", "description", "row_count")


@register(
    "sitemap_lines",
    f"WITH {_SITE_CTE} "
    "SELECT site, 0 AS section, CAST(0 AS BIGINT) AS rank_key, '' AS path_key, "
    "'<?xml version=\"1.0\" encoding=\"UTF-8\"?>' AS line FROM sites "
    "UNION ALL SELECT site, 0, CAST(1 AS BIGINT), '', "
    "'<urlset xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\">' FROM sites "
    "UNION ALL SELECT site, 1, CAST(0 AS BIGINT), '', '  <url><loc>' || base || '/</loc></url>' FROM sites "
    "UNION ALL SELECT site, 2, -row_count, path, '  <url><loc>' || base || path || '</loc></url>' FROM rt "
    "UNION ALL SELECT site, 3, CAST(0 AS BIGINT), '', '</urlset>' FROM sites",
)
def sitemap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-site sitemap lines with their order keys."""
    _, sites, routes = region_routes(spark, sf_dir)
    return P.sitemap_lines(routes.select("site", "path", "row_count"), sites)


@register(
    "robots_txt",
    f"WITH {_SITE_CTE} SELECT site, 'User-agent: *' || chr(10) || 'Allow: /' || chr(10) || 'Sitemap: ' "
    "|| CASE WHEN base <> '' THEN base || '/sitemap.xml' ELSE '/sitemap.xml' END || chr(10) AS body FROM sites",
)
def robots_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots.txt per site."""
    return P.robots_txt(region_sites(spark, sf_dir))


@register(
    "route_json_ld",
    f"WITH {_SITE_CTE} SELECT site, path, CAST(json_object('@context', 'https://schema.org', '@type', 'ItemList', "
    "'name', title, 'description', description, 'numberOfItems', row_count) AS VARCHAR) AS json_ld FROM rt",
)
def route_json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ItemList structured data of every route page."""
    _, _, routes = region_routes(spark, sf_dir)
    return routes.select("site", "path", P.json_ld_route(F.col("title"), F.col("description"),
                                                         F.col("row_count")).alias("json_ld"))


@register(
    "site_json_ld",
    f"WITH {_SITE_CTE} SELECT site, CAST(json_object('@context', 'https://schema.org', '@type', 'Dataset', "
    "'name', niche, 'description', niche, 'url', base) AS VARCHAR) AS json_ld FROM sites",
)
def site_json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Dataset structured data of every site index (no description -> the title)."""
    sites = region_sites(spark, sf_dir)
    return sites.select("site", P.json_ld_index(F.col("niche"), F.lit(""), F.col("base")).alias("json_ld"))


_PAGE_COLS = ["c_custkey", "c_name", "n_name", "c_mktsegment", "c_acctbal"]


def _esc(x: str) -> str:
    return (f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
            "'\"', '&quot;')")


_HEAD_SQL = [
    "'<!doctype html>'",
    "'<html lang=\"en\">'",
    "'<head>'",
    f"'<title>' || {_esc('title')} || '</title>'",
    f"'<meta name=\"description\" content=\"' || {_esc('description')} || '\" />'",
    "CASE WHEN base <> '' THEN '<link rel=\"canonical\" href=\"' || base || path || '\" />' ELSE '' END",
    "'<script type=\"application/ld+json\">' || CAST(json_object('@context', 'https://schema.org', '@type', "
    "'ItemList', 'name', title, 'description', description, 'numberOfItems', row_count) AS VARCHAR) || '</script>'",
    "'</head>'",
    "'<body>'",
    f"'<h1>' || {_esc('title')} || '</h1>'",
    f"'<p>' || {_esc('description')} || '</p>'",
    "'<table><thead><tr>" + "".join(f"<th>{c}</th>" for c in _PAGE_COLS) + "</tr></thead><tbody>'",
]


@register(
    "rendered_pages",
    f"WITH {_SITE_CTE} "
    + " UNION ALL ".join(
        f"SELECT path, 0 AS part, CAST({i} AS BIGINT) AS seq, {expr} AS line FROM rt" for i, expr in enumerate(_HEAD_SQL)
    )
    + " UNION ALL SELECT rt.path, 1, CAST(ds.c_custkey AS BIGINT), '<tr>' || "
    + " || ".join(f"'<td>' || {_esc(f'coalesce(CAST(ds.{c} AS VARCHAR), {chr(39)}{chr(39)})')} || '</td>'"
                  for c in _PAGE_COLS)
    + " || '</tr>' FROM ds JOIN rt ON ds.site = rt.site AND ds.n_name = rt.n_name AND ds.c_mktsegment = rt.c_mktsegment"
    " UNION ALL SELECT path, 2, CAST(0 AS BIGINT), '</tbody></table></body></html>' FROM rt",
)
def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every route page as ordered HTML lines (one line per data row)."""
    ds, sites, routes = region_routes(spark, sf_dir)
    members = R.route_rows(ds, routes, ["n_name", "c_mktsegment"], site="site")
    with_base = routes.join(sites.select("site", "base"), "site")
    # Paths are unique per site; the oracle's page key is the path within the
    # site, so both sides key pages by path.
    return P.render_route_pages(with_base, members, _PAGE_COLS, F.col("base"), "c_custkey").select(
        "path", "part", "seq", "line")


_LINES_CTE = (
    "WITH " + _SITE_CTE + ", lines AS (" + " UNION ALL ".join(
        f"SELECT site, path, 0 AS part, CAST({i} AS BIGINT) AS seq, {expr} AS line FROM rt" for i, expr in enumerate(_HEAD_SQL))
    + " UNION ALL SELECT rt.site, rt.path, 1, CAST(ds.c_custkey AS BIGINT), '<tr>' || "
    + " || ".join(f"'<td>' || {_esc(f'coalesce(CAST(ds.{c} AS VARCHAR), {chr(39)}{chr(39)})')} || '</td>'" for c in _PAGE_COLS)
    + " || '</tr>' FROM ds JOIN rt ON ds.site = rt.site AND ds.n_name = rt.n_name AND ds.c_mktsegment = rt.c_mktsegment"
    " UNION ALL SELECT site, path, 2, CAST(0 AS BIGINT), '</tbody></table></body></html>' FROM rt)")


def packed_pages(spark: SparkSession, sf_dir: str) -> str:
    """The pages of all region sites, written to containers."""
    ds, sites, routes = region_routes(spark, sf_dir)
    root = scratch_dir(spark, "pages")
    members = R.route_rows(ds, routes, ["n_name", "c_mktsegment"], site="site")
    with_base = routes.join(sites.select("site", "base"), "site")
    lines = P.render_route_pages(with_base, members, _PAGE_COLS, F.col("base"), "c_custkey", site="site")
    write_documents(lines, root, ["site", "path"], ["part", "seq"])
    return root


@register(
    "page_index",
    _LINES_CTE + "SELECT site, path, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, count(*) AS lines FROM lines GROUP BY ALL",
)
def page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's bytes and lines by the containers' index, keyed by site and path."""
    index = document_index(spark, packed_pages(spark, sf_dir))
    return index.groupBy("site", "path").agg(F.sum("length").alias("bytes"), F.sum("lines").alias("lines"))


@register(
    "page_lookup",
    _LINES_CTE + "SELECT CAST(row_number() OVER (ORDER BY part, seq) AS BIGINT) AS n, line FROM lines "
    "WHERE (site, path) = (SELECT (max(site), max_by(path, (site, path))) FROM rt)",
)
def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page read by its byte ranges, line by line."""
    root = packed_pages(spark, sf_dir)
    last = document_index(spark, root).orderBy(F.desc("site"), F.desc("path")).first()
    page = read_document(spark, root, site=last["site"], path=last["path"]).decode()
    return spark.createDataFrame(list(enumerate(page.split("\n")[:-1], 1)), "n long, line string")


_TRIM = "regexp_replace({x}, '\\.?0+$', '')"
_BIG_SQL = "'9' || l_orderkey || '0000000000' || l_linenumber || '.' || CASE WHEN l_linenumber = 1 THEN '00' ELSE '50' END"


@register(
    "rows_json_text",
    f"""SELECT '{{"big":' || {_TRIM.format(x=_BIG_SQL)} || ',"cells":[' || CAST(l_discount AS VARCHAR) || ',' ||
CASE WHEN l_linenumber = 2 THEN 'null' ELSE CAST(l_tax AS VARCHAR) END || '],"line":{{"flag":"' || l_returnflag || '","parts":[{{"no":' ||
CAST(l_linenumber AS VARCHAR) || '}},null]}},"by":{{"' || l_linestatus || '":' ||
CASE WHEN l_linenumber = 3 THEN 'null' ELSE CAST(l_quantity AS DOUBLE)::VARCHAR END || '}}}}' AS line FROM lineitem""",
)
def rows_json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict JSON rows with decimals above 2^53, and NaN inside arrays, structs and maps; written and read back."""
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    nan = F.lit(float("nan"))
    number = F.concat(F.lit("9"), F.col("l_orderkey"), F.lit("0000000000"), n, F.lit("."), F.when(n == 1, "00").otherwise("50"))
    rows = li.select(
        number.cast("decimal(38,2)").alias("big"),
        F.array(F.col("l_discount"), F.when(n == 2, nan).otherwise(F.col("l_tax"))).alias("cells"),
        F.struct(F.col("l_returnflag").alias("flag"), F.array(
            F.struct(n.cast("decimal(10,3)").alias("no")), F.lit(None)).alias("parts")).alias("line"),
        F.create_map(F.col("l_linestatus"), F.when(n == 3, nan).otherwise(F.col("l_quantity").cast("double"))).alias("by"))
    out = scratch_dir(spark, "rows")
    W.write_rows(rows, out)
    return spark.read.text(out).select(F.col("value").alias("line"))


_CATALOG_TABLES = ["lineitem", "orders", "part", "customer", "supplier", "events"]


_CALC_SQL = (
    "WITH num AS (SELECT * FROM (SELECT table_name AS dataset, column_name, ordinal_position AS ordinal, "
    "row_number() OVER (PARTITION BY table_name ORDER BY ordinal_position) AS rn "
    "FROM information_schema.columns WHERE table_name IN ({tables}) AND regexp_full_match(data_type, "
    "'(TINYINT|SMALLINT|INTEGER|BIGINT|FLOAT|DOUBLE|DECIMAL.*)')) WHERE rn <= 5) "
    "SELECT dataset, CAST(json_object('base', 0, 'result_label', 'Estimated Value', 'inputs', "
    "to_json(list(json_object('key', column_name, 'label', {label}, 'default', 1, 'weight', 1) "
    "ORDER BY ordinal))) AS VARCHAR) AS calculator FROM num GROUP BY dataset"
)


@register(
    "calculator_blocks",
    _CALC_SQL.format(tables=", ".join(f"'{t}'" for t in ["lineitem", "orders", "part", "customer", "supplier",
                                                          "events"]),
                     label=_TITLE_SQL.format(x="replace(column_name, '_', ' ')")),
)
def calculator_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calculator config of each dataset from its profiled catalogue."""
    cats = None
    for t in _CATALOG_TABLES:
        cat, _, _ = files.profile_dataset(table(spark, sf_dir, t))
        cat = cat.withColumn("dataset", F.lit(t))
        cats = cat if cats is None else cats.unionByName(cat)
    blocks = P.calculator_blocks(cats)
    return blocks.select("dataset", F.to_json("calculator").alias("calculator"))


@register(
    "numeric_columns",
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{t}' AS dataset, column_name, CAST(ordinal_position AS INTEGER) AS ordinal "
        f"FROM information_schema.columns WHERE table_name = '{t}' AND regexp_full_match(data_type, "
        "'(TINYINT|SMALLINT|INTEGER|BIGINT|FLOAT|DOUBLE|DECIMAL.*)') ORDER BY ordinal_position LIMIT 5)"
        for t in _CATALOG_TABLES
    ),
)
def numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First five numeric columns of each dataset, in column order."""
    cats = None
    for t in _CATALOG_TABLES:
        cat, _, _ = files.profile_dataset(table(spark, sf_dir, t))
        cat = cat.withColumn("dataset", F.lit(t))
        cats = cat if cats is None else cats.unionByName(cat)
    return P.numeric_columns(cats).select("dataset", "column_name", "ordinal")


@register("site_meta")
def site_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict-JSON meta document of every site."""
    ds, sites, routes = region_routes(spark, sf_dir)
    counts = routes.groupBy("site").agg(F.count(F.lit(1)).alias("route_count"))
    cat, _, _ = files.profile_dataset(ds.drop("site"))
    calc = P.calculator_blocks(cat.withColumn("dataset", F.lit("customers")))
    cols = [c for c in ds.columns if c != "site"]
    meta_in = sites.crossJoin(F.broadcast(calc.select("calculator"))).select(
        "site",
        F.col("site").alias("niche_id"),
        F.lit(None).cast("string").alias("target_dataset_url"),
        "template_type",
        F.lit("local_lead_generation").alias("monetization_pattern"),
        F.lit("/{nation}/{segment}").alias("seo_route_pattern"),
        F.array(F.lit("n_name"), F.lit("c_mktsegment")).alias("seo_high_volume_columns"),
        F.array().cast("array<string>").alias("seo_sample_routes"),
        F.lit(0.81).alias("confidence"),
        F.array(*[F.lit(c) for c in cols]).alias("columns"),
        "calculator",
    )
    meta = P.site_meta(meta_in, counts)
    return meta.select("site", F.to_json("meta", {"ignoreNullFields": "false"}).alias("meta_json"))


_INDEX_HEAD_SQL = [
    "'<!doctype html>'",
    "'<html lang=\"en\">'",
    "'<head>'",
    f"'<title>' || {_esc('niche')} || '</title>'",
    f"CASE WHEN site <> '' THEN '<meta name=\"description\" content=\"' || {_esc('site')} || '\" />' ELSE '' END",
    "CASE WHEN base <> '' THEN '<link rel=\"canonical\" href=\"' || base || '/\" />' ELSE '' END",
    "'<script type=\"application/ld+json\">' || CAST(json_object('@context', 'https://schema.org', '@type', "
    "'Dataset', 'name', niche, 'description', CASE WHEN site = '' THEN niche ELSE site END, 'url', base) AS VARCHAR) "
    "|| '</script>'",
    "'</head>'",
    "'<body>'",
    f"'<h1>' || {_esc('niche')} || '</h1>'",
    "'<nav>'",
]


@register(
    "index_pages",
    f"WITH {_SITE_CTE} "
    + " UNION ALL ".join(
        f"SELECT site, 0 AS part, CAST({i} AS BIGINT) AS rank_key, '' AS path_key, {expr} AS line FROM sites"
        for i, expr in enumerate(_INDEX_HEAD_SQL)
    )
    + f" UNION ALL SELECT site, 1, -row_count, path, '<a href=\"' || {_esc('path')} || '\">' || {_esc('title')} "
    "|| '</a>' FROM rt UNION ALL SELECT site, 2, CAST(0 AS BIGINT), '', '</nav></body></html>' FROM sites",
)
def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site's index page with its navigation list of route links."""
    _, sites, routes = region_routes(spark, sf_dir)
    site_docs = sites.select("site", F.col("niche").alias("title"), F.col("site").alias("description"), "base")
    return P.render_index_pages(routes.select("site", "path", "title", "row_count"), site_docs)
