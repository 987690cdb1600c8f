"""Route and source queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefleet.operators import routes as R
from pagefleet.plans.registry import register, slug_sql, table
from pagefleet.session import spread
from pagefleet.sources import files

# Whitespace for word splitting, identical in Java regex and RE2.
WORD_SPLIT = r"[ \t\n\r\f\x0B]+"
# Python str.isspace() characters, spelled for RE2 (oracle side of C6).
_BLANK_RE2 = r"[\t\n\x0B\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"


def customer_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset with a geo and a category route column: customer ⋈ nation."""
    cust = table(spark, sf_dir, "customer")
    nat = table(spark, sf_dir, "nation")  # 25 rows by definition
    return cust.join(F.broadcast(nat), cust.c_nationkey == nat.n_nationkey).select(
        "c_custkey", "c_name", "n_name", "c_mktsegment", "c_acctbal"
    )


# First appearance of a word = (doc_id, position in the doc). The oracle packs both into one long, which holds up to 2**20 words per document and doc ids below 2**43.
POS_BITS = 20


def first_place() -> Column:
    """(doc_id, pos) as one number, so that its minimum stays in the hash aggregate."""
    return F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31) + F.col("pos")


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document (whole texts), with its position."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(F.split("text", WORD_SPLIT)).alias("pos", "word"))


_GEO_CTE = """
ds AS (
  SELECT c.c_custkey, n.n_name, c.c_mktsegment
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""


def _route_sql(cte: str, k0: str, k1: str | None, first: str, niche: str, cap: int | None) -> tuple[str, str]:
    """(CTE chain ending in ``p``, select list of the route columns) for DuckDB."""
    keys = f"{k0}" + (f", {k1}" if k1 else "")
    nonblank = f"NOT regexp_full_match(coalesce({k0}, ''), '{_BLANK_RE2}')" + (
        f" AND NOT regexp_full_match(coalesce({k1}, ''), '{_BLANK_RE2}')" if k1 else ""
    )
    label = f"{k0}" + (f" || ' · ' || {k1}" if k1 else "")
    segs = f"{slug_sql(k0)} AS s0" + (f", {slug_sql(k1)} AS s1" if k1 else "")
    path = "'/' || s0" + (" || '/' || s1" if k1 else "")
    nonempty = "s0 <> ''" + (" AND s1 <> ''" if k1 else "")
    capped = f"ORDER BY row_count DESC, first_pos ASC LIMIT {cap}" if cap is not None else ""
    return f"""
WITH {cte},
g AS (
  SELECT {keys}, count(*) AS row_count, min({first}) AS first_pos
  FROM ds WHERE {nonblank}
  GROUP BY {keys} {capped}
),
s AS (SELECT *, {segs} FROM g),
p AS (
  SELECT *, {path} AS natural_path,
         row_number() OVER (PARTITION BY {path} ORDER BY row_count DESC, first_pos ASC) AS copy_no
  FROM s WHERE {nonempty}
)""", f"""CASE WHEN copy_no = 1 THEN natural_path ELSE natural_path || '-' || CAST(copy_no AS VARCHAR) END AS path,
       {label} || ' — {niche}' AS title,
       '{niche}: ' || {label} || '. ' || CAST(row_count AS VARCHAR) || ' matching record(s).' AS description,
       row_count"""


def _geo_routes(spark: SparkSession, sf_dir: str, cap: int | None) -> DataFrame:
    ds = customer_geo(spark, sf_dir)
    routes = R.build_routes(
        ds, ["n_name", "c_mktsegment"], "Customer Segments", max_routes=cap, order_by=["c_custkey"], keep_keys=True
    )
    return routes.select("path", "title", "description", "row_count",
                         F.col("k0").alias("nation"), F.col("k1").alias("segment"))


@register(
    "routes_segment",
    "{0} SELECT {1}, n_name AS nation, c_mktsegment AS segment FROM p".format(
        *_route_sql(_GEO_CTE, "n_name", "c_mktsegment", "c_custkey", "Customer Segments", None)),
)
def routes_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One route per (nation, segment), whole dataset."""
    return _geo_routes(spark, sf_dir, None)


@register(
    "routes_capped",
    "{0} SELECT {1}, n_name AS nation, c_mktsegment AS segment FROM p".format(
        *_route_sql(_GEO_CTE, "n_name", "c_mktsegment", "c_custkey", "Customer Segments", 20)),
)
def routes_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest routes (ties: first appearance)."""
    return _geo_routes(spark, sf_dir, 20)


@register(
    "route_membership",
    "{0}, r AS (SELECT {1}, n_name, c_mktsegment FROM p)".format(
        *_route_sql(_GEO_CTE, "n_name", "c_mktsegment", "c_custkey", "Customer Segments", None))
    + """
SELECT ds.c_custkey, r.path FROM ds JOIN r ON ds.n_name = r.n_name AND ds.c_mktsegment = r.c_mktsegment""",
)
def route_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer row with the path of its route page."""
    ds = customer_geo(spark, sf_dir)
    routes = R.build_routes(ds, ["n_name", "c_mktsegment"], "Customer Segments",
                            max_routes=None, order_by=["c_custkey"], keep_keys=True)
    return R.route_rows(ds, routes, ["n_name", "c_mktsegment"]).select("c_custkey", "path")


_WORDS_CTE = f"""
ds AS (
  SELECT doc_id, word, pos FROM (
    SELECT doc_id, unnest(parts) AS word, unnest(range(len(parts))) AS pos
    FROM (SELECT doc_id, string_split_regex(text, '{WORD_SPLIT}') AS parts FROM documents)
  )
)"""


@register(
    "word_routes",
    "{0} SELECT {1} FROM p".format(
        *_route_sql(_WORDS_CTE, "word", None, f"doc_id * {1 << POS_BITS} + pos", "Document Words", None)),
)
def word_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 + F1 over every word of every document: case and punctuation variants
    of a word share a slug, so paths collide and are disambiguated."""
    words = document_words(spark, sf_dir)
    routes = R.build_routes(words, ["word"], "Document Words", max_routes=None, order_by=[first_place()])
    return routes.select("path", "title", "description", "row_count")


#: Keys of one hot path: every third word spelled in marks, which slugs drop.
_MARKS = "!\"#$%&()*+,./:;<=>?@[]^_`{|"
_HOT_SQL = f"""
ds AS (
  SELECT lang, doc_id, pos, CASE WHEN length(word) % 3 = 0
    THEN 'Hot' || translate(lower(word), 'abcdefghijklmnopqrstuvwxyz', '{_MARKS}') ELSE word END AS word FROM (
    SELECT lang, doc_id, unnest(parts) AS word, unnest(range(len(parts))) AS pos
    FROM (SELECT lang, doc_id, string_split_regex(text, '{WORD_SPLIT}') AS parts FROM documents)
  )
)"""


@register(
    "site_word_routes",
    f"""WITH {_HOT_SQL},
g AS (SELECT lang, word, count(*) AS row_count, min(doc_id * {1 << POS_BITS} + pos) AS first_pos FROM ds
      WHERE NOT regexp_full_match(coalesce(word, ''), '{_BLANK_RE2}') GROUP BY ALL),
s AS (SELECT *, {slug_sql('word')} AS slug FROM g)
SELECT lang, '/' || slug || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '-' || CAST(row_number() OVER w AS VARCHAR) END AS path,
       word, row_count FROM s WHERE slug <> '' WINDOW w AS (PARTITION BY lang, slug ORDER BY row_count DESC, first_pos)""",
)
def site_word_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 per site over every word of every document, a third of which share one path of their site."""
    docs = spread(table(spark, sf_dir, "documents").select("lang", "doc_id", "text"))
    words = docs.select("lang", "doc_id", F.posexplode(F.split("text", WORD_SPLIT)).alias("pos", "word"))
    hot = F.concat(F.lit("Hot"), F.translate(F.lower("word"), "abcdefghijklmnopqrstuvwxyz", _MARKS))
    words = words.withColumn("word", F.when(F.length("word") % 3 == 0, hot).otherwise(F.col("word")))
    routes = R.build_routes(words, ["word"], "Words", order_by=[first_place()], keep_keys=True, site="lang")
    return routes.select("lang", "path", F.col("k0").alias("word"), "row_count")


@register(
    "profile_lineitem",
    """
SELECT column_name, data_type AS column_type, CAST(ordinal_position AS INTEGER) AS ordinal,
       (SELECT count(*) FROM lineitem) AS row_count
FROM information_schema.columns WHERE table_name = 'lineitem'""",
)
def profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 A3: column catalogue of a parquet dataset with its row count."""
    df = files.open_dataset(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet")
    catalogue, _, _ = files.profile_dataset(df)
    return catalogue


# (order, line number) repeats in the generated lineitem table; these six
# columns are unique, so the sample order is total.
_SAMPLE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@register("profile_sample", f"SELECT * FROM lineitem ORDER BY {', '.join(_SAMPLE_ORDER)} LIMIT 100")
def profile_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: the 100-row sample (the limit is the operator), in a total order."""
    df = files.open_dataset(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet")
    _, _, sample = files.profile_dataset(df, limit=100, order_by=_SAMPLE_ORDER)
    return sample


@register(
    "profile_stats",
    "SELECT (SELECT count(*) FROM orders) AS row_count, CAST(6 AS BIGINT) AS column_count",
)
def profile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: row and column counts of a dataset."""
    df = files.open_dataset(spark, f"{sf_dir.rstrip('/')}/orders.parquet")
    _, stats, _ = files.profile_dataset(df)
    return stats


_VIEW_SQL = (
    "SELECT s_nationkey, count(*) AS n_suppliers, round(sum(s_acctbal), 2) AS total_acctbal "
    "FROM {view} WHERE s_acctbal > {floor} GROUP BY s_nationkey"
)


@register("sql_view", _VIEW_SQL.format(view="supplier", floor="0"))
def sql_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register a file as a view, run parameterised SQL over it."""
    files.register_dataset(spark, "suppliers", f"{sf_dir.rstrip('/')}/supplier.parquet")
    return files.query(spark, _VIEW_SQL.format(view="suppliers", floor=":floor"), {"floor": 0})


@register("lookup_by_id", "SELECT * FROM orders WHERE o_orderkey = 7")
def lookup_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by primary key (none when absent)."""
    from pagefleet.operators.ledger import lookup_by_id as lookup

    return lookup(table(spark, sf_dir, "orders"), "o_orderkey", 7)


@register(
    "route_params",
    "{0} SELECT {1}, CAST(json_object('n_name', n_name, 'c_mktsegment', c_mktsegment) AS VARCHAR) AS params_json, "
    "CAST(json_array('n_name', 'c_mktsegment') AS VARCHAR) AS columns_used_json FROM p".format(
        *_route_sql(_GEO_CTE, "n_name", "c_mktsegment", "c_custkey", "Customer Segments", None)),
)
def route_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each route's params map and columns used (as JSON text)."""
    ds = customer_geo(spark, sf_dir)
    routes = R.build_routes(ds, ["n_name", "c_mktsegment"], "Customer Segments", max_routes=None,
                            order_by=["c_custkey"])
    return routes.select("path", "title", "description", "row_count",
                         F.to_json("params").alias("params_json"), F.to_json("columns_used").alias("columns_used_json"))
