"""Landed payload parsers: A4 read_manifest, A5 parse_ckan_packages,
A6 parse_keyword_overview, A7 parse_rum_groups, A11 read_site_meta.

Network clients are not part of this library: payloads are landed as files
(one JSON document per file, or one per line) and parsed here in parallel,
one document per row. Shape tolerance and "failure is a row" semantics are
kept with ``try_*`` functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagefleet import schemas
from pagefleet.functions import text


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``doc_path`` (decoded from the file URI), ``value`` (whole text)."""
    return spark.read.text(path, wholetext=True).select(
        F.url_decode(F.col("_metadata.file_path")).alias("doc_path"), F.col("value")
    )


def manifest_candidates(docs: DataFrame, value: str = "value", source_id: str = "manifest") -> DataFrame:
    """A4 core: manifest documents -> ``doc_path, pos, candidate, error``.

    A document is ``{candidates: [...]}`` or a bare array. Non-object entries
    are dropped; ``source`` is set to ``source_id`` only when the key is
    absent. Invalid JSON or a non-array becomes one error row.
    """
    v = F.try_parse_json(F.col(value))
    kind = F.schema_of_variant(v)
    from_obj = F.try_variant_get(v, "$.candidates", "array<variant>")
    from_arr = F.try_variant_get(v, "$", "array<variant>")
    arr = F.when(kind.startswith("OBJECT"), from_obj).when(kind.startswith("ARRAY"), from_arr)
    obj_missing = kind.startswith("OBJECT") & F.variant_get(v, "$.candidates", "variant").isNull()
    arr = F.when(obj_missing, F.array().cast("array<variant>")).otherwise(arr)
    error = (
        F.when(v.isNull(), F.lit("failed to read manifest: invalid JSON"))
        .when(~(kind.startswith("OBJECT") | kind.startswith("ARRAY")), F.lit("manifest must be a JSON object or array"))
        .when(arr.isNull(), F.lit("manifest 'candidates' must be an array"))
    )
    staged = docs.select("doc_path", arr.alias("_arr"), error.alias("error"))
    bad = staged.filter(F.col("error").isNotNull()).select(
        "doc_path", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("variant").alias("candidate"), "error")
    good = staged.filter(F.col("error").isNull()).select("doc_path", F.posexplode("_arr").alias("pos", "c"))
    good = good.filter(F.schema_of_variant("c").startswith("OBJECT"))
    has_source = F.variant_get(F.col("c"), "$.source", "variant").isNotNull()
    cand_map = F.try_variant_get(F.col("c"), "$", "map<string,variant>")
    with_source = F.when(has_source, F.col("c")).otherwise(
        F.to_variant_object(F.map_concat(cand_map, F.create_map(F.lit("source"), F.parse_json(F.lit(f'"{source_id}"')))))
    )
    good = good.select("doc_path", "pos", with_source.alias("candidate"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(bad)


def read_manifest(spark: SparkSession, path: str, source_id: str = "manifest") -> DataFrame:
    """A4: candidates from manifest files (a file, folder or glob); a missing
    path is one error row (a source error), not an exception."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001 - existence check only
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    if not fs.globStatus(jvm_path):
        return spark.createDataFrame([(path, f"manifest not found: {path}")], "doc_path string, error string") \
            .select("doc_path", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("variant").alias("candidate"),
                    "error")
    return manifest_candidates(_documents(spark, path), source_id=source_id)


_CKAN = T.StructType([
    T.StructField("success", T.BooleanType()),
    T.StructField("result", T.StructType([
        T.StructField("results", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("id", T.StringType()),
            T.StructField("tags", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
            T.StructField("resources", T.ArrayType(T.StructType([
                T.StructField("format", T.StringType()), T.StructField("url", T.StringType()),
            ]))),
        ]))),
    ])),
])


def parse_ckan_packages(raw: DataFrame, value: str = "value", source_id: str = "opendata") -> DataFrame:
    """A5: landed package-search payloads -> partial candidates (+ error rows).

    ``success`` false/absent is a source error. Packages without resources or
    without any resource URL are dropped. Uses I20 (primary resource), I21
    (name/id/fallback), I22 (first ten tag names) and E8 (formats).
    """
    p = F.from_json(F.col(value), _CKAN)
    staged = raw.select(p.alias("_p"))
    errors = staged.filter(~F.coalesce(F.col("_p.success"), F.lit(False))).select(
        F.lit(source_id).alias("source_id"), F.lit("open-data portal returned success=false").alias("error"))
    pk = staged.filter(F.col("_p.success")).select(F.posexplode("_p.result.results").alias("pos", "pkg"))
    res = F.coalesce(F.col("pkg.resources"), F.array())
    has_url = lambda r: F.coalesce(r["url"], F.lit("")) != ""
    tabular = F.filter(res, lambda r: F.lower(F.coalesce(r["format"], F.lit(""))).isin(*schemas.TABULAR_FORMATS)
                       & has_url(r))
    primary = F.coalesce(F.try_element_at(tabular, F.lit(1)), F.try_element_at(F.filter(res, has_url), F.lit(1)))
    formats = F.array_sort(F.array_distinct(F.transform(
        F.filter(res, lambda r: F.coalesce(r["format"], F.lit("")) != ""), lambda r: F.lower(r["format"]))))
    keywords = F.slice(F.transform(
        F.filter(F.coalesce(F.col("pkg.tags"), F.array()), lambda t: F.coalesce(t["name"], F.lit("")) != ""),
        lambda t: t["name"]), 1, 10)
    cands = pk.filter((F.size(res) > 0) & primary.isNotNull()).select(
        "pos",
        text.first_non_empty("pkg.name", "pkg.id").alias("niche_id"),
        F.coalesce(primary["url"], F.lit("")).alias("target_dataset_url"),
        keywords.alias("primary_keywords"),
        formats.alias("data_sources_available"),
        F.lit(source_id).alias("source"),
    )
    return cands, errors


_KEYWORD_ROW = "struct<keyword string, volume string, cpc string, difficulty variant, keyword_difficulty string>"


def keyword_overview_lists(raw: DataFrame, value: str = "value", key: str = "key") -> DataFrame:
    """Each payload with its keyword rows as a list, ``key, items`` (null: no rows), rows as in
    ``parse_keyword_overview``. Whatever reduces a payload's rows needs no sort of all rows."""
    v = F.col("_v")
    arr = F.coalesce(*[F.try_variant_get(v, path, f"array<{_KEYWORD_ROW}>")
                       for path in ("$", *(f"$.{k}" for k in schemas.KEYWORD_ROW_KEYS))])
    # Falsy (null, 0, false, "", [], {}) difficulty falls through to
    # keyword_difficulty; the test needs its JSON form: "0" in quotes is truthy.
    falsy = ("null", "false", '""', "[]", "{}", "0")

    def truthy(form: Column) -> Column:
        return F.coalesce(~form.isin(*falsy) & F.coalesce(form.try_cast("double") != 0, F.lit(True)), F.lit(False))

    rows = F.transform(arr, lambda r, n: F.when(r.isNotNull(), F.struct(
        n.alias("pos"), r["keyword"].alias("keyword"), r["volume"].alias("volume"), r["cpc"].alias("cpc"),
        F.try_variant_get(r["difficulty"], "$", "string").alias("difficulty"),
        r["keyword_difficulty"].alias("keyword_difficulty"), truthy(F.to_json(r["difficulty"])).alias("difficulty_truthy"))))
    parsed = raw.select(F.col(key), F.try_parse_json(F.col(value)).alias("_v"))
    return parsed.select(key, F.filter(rows, lambda r: r.isNotNull()).alias("items"))


def parse_keyword_overview(raw: DataFrame, value: str = "value", key: str = "key") -> DataFrame:
    """Shape-tolerant keyword rows ``key, pos, keyword, volume, cpc, difficulty,
    keyword_difficulty`` (values as text; E2 converts). A top-level array, else
    the first of ``keywords, metrics, results, data`` holding an array;
    non-object entries dropped; anything else gives no rows."""
    return keyword_overview_lists(raw, value, key).select(key, F.inline("items"))


_RUM = T.StructType([T.StructField("data", T.StructType([T.StructField("viewer", T.StructType([
    T.StructField("accounts", T.ArrayType(T.StructType([
        T.StructField("rumPageloadEventsAdaptiveGroups", T.ArrayType(T.StructType([
            T.StructField("count", T.StringType()),
            T.StructField("sum", T.StructType([T.StructField("visits", T.StringType())])),
            T.StructField("dimensions", T.StructType([T.StructField("requestPath", T.StringType())])),
        ]))),
    ]))),
]))]))])


def parse_rum_groups(raw: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Analytics payloads -> one row per group ``page_path, impressions,
    clicks, revenue_cents``; missing/null numbers -> 0, missing path -> '/',
    truncating int conversion; groups with the same path stay separate rows."""
    keep = keep or []
    p = F.from_json(F.col(value), _RUM)
    acc = raw.select(*keep, F.explode_outer(p["data"]["viewer"]["accounts"]).alias("a"))
    grp = acc.select(*keep, F.posexplode(F.coalesce(F.col("a.rumPageloadEventsAdaptiveGroups"), F.array()))
                     .alias("group_pos", "g"))

    def num(c: Column) -> Column:
        x = c.try_cast("double")  # NaN, and what no 64-bit integer holds, count as missing
        return F.coalesce(F.when(~F.isnan(x), x).try_cast("long"), F.lit(0).cast("long"))

    return grp.select(
        *keep, "group_pos",
        F.coalesce(F.col("g.dimensions.requestPath"), F.lit("/")).alias("page_path"),
        num(F.col("g.count")).alias("impressions"),
        num(F.col("g.sum.visits")).alias("clicks"),
        F.lit(0).cast("long").alias("revenue_cents"),
    )


def judge_rum_payloads(raw: DataFrame, value: str = "value") -> DataFrame:
    """Every payload with its ``error`` (null: none) and its number of ``groups``.

    One that doesn't parse, is not an object or carries ``errors`` has an error: its source failed
    rather than being idle. One without error and groups is empty.
    """
    text = F.col(value)
    errors = F.from_json(text, "errors array<struct<message: string>>")["errors"]
    told = F.array_join(F.transform(errors, lambda e: F.coalesce(e["message"], F.lit("unknown error"))), "; ")
    kind = F.schema_of_variant(F.try_parse_json(text))
    error = F.when(kind.isNull(), F.lit("payload is not JSON")).when(
        ~kind.startswith("OBJECT"), F.lit("payload is not a JSON object")).when(F.size(errors) > 0, told)
    accounts = F.coalesce(F.from_json(text, _RUM)["data"]["viewer"]["accounts"], F.array())
    groups = F.aggregate(accounts, F.lit(0), lambda n, a: n + F.coalesce(
        F.size(F.coalesce(a["rumPageloadEventsAdaptiveGroups"], F.array())), F.lit(0)))
    return raw.select("*", error.alias("error"), groups.alias("groups"))


def parse_rum_errors(raw: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Analytics payloads that carry ``errors`` or don't parse -> ``error``, one row per payload."""
    return judge_rum_payloads(raw, value).select(*(keep or []), "error").where(F.col("error").isNotNull())


def read_site_meta(spark: SparkSession, path: str) -> DataFrame:
    """Existing site meta documents ``site_path, meta``; unreadable -> ``{}``."""
    docs = _documents(spark, path)
    return docs.select(
        F.col("doc_path").alias("site_path"),
        F.coalesce(F.try_parse_json("value"), F.parse_json(F.lit("{}"))).alias("meta"),
    )
