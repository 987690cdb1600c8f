"""Queries over inputs that used to be cut, altered or fatal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefleet import schemas
from pagefleet.operators import routes as R
from pagefleet.operators import scoring as S
from pagefleet.plans.registry import register, table
from pagefleet.plans.route_queries import _route_sql
from pagefleet.session import scratch_dir, spread
from pagefleet.sources import files


@register("json_mixed_read", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def json_mixed_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: one folder of array documents, line-delimited files and pretty-printed objects."""
    # Spread: each task writes its own files of one record.
    cust = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    path = scratch_dir(spark, "mixed") + "/mixed.json"
    key, row = F.col("c_custkey"), F.struct("*")
    arrays = cust.where(key % 3 == 0).groupBy(F.floor(key / 1000)).agg(F.to_json(F.collect_list(row)).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    pretty = cust.where(key % 300 == 2).select(F.regexp_replace(F.to_json(row), r'([{,])"', '$1\n  "').alias("value"))
    pretty.write.mode("append").option("maxRecordsPerFile", 1).text(path)
    cust.where((key % 3 != 0) & (key % 300 != 2)).write.mode("append").json(path)
    return files.open_dataset(spark, path).select("c_custkey", "c_name", "c_mktsegment")


@register(
    "routes_uncapped",
    "{0} SELECT {1} FROM p".format(*_route_sql(
        "ds AS (SELECT c_custkey, c_name, c_mktsegment FROM customer)", "c_name", "c_mktsegment", "c_custkey",
        "Customers", None)),
)
def routes_uncapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default arguments route every key combination, one per customer here."""
    routes = R.build_routes(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"], "Customers", order_by=["c_custkey"])
    return routes.select("path", "title", "description", "row_count")


_VOLUMES = ["45000", "9007199254740993", '"NaN"', "12.5", "1e30", '"17"']
_INT, _FRACTION = schemas.MSG_INT.replace("'", "''"), schemas.MSG_INT_FRACTION.replace("'", "''")
_BOUND = schemas.MSG_LE.format(100).replace("'", "''")


@register(
    "candidates_hostile",
    "WITH c AS (SELECT 'part-' || p_partkey AS niche_id, p_partkey % 6 AS k, p_partkey % 7 = 0 AS far FROM part), "
    "e AS (SELECT *, concat_ws('; ', "
    f"CASE WHEN k IN (2, 4) THEN 'estimated_monthly_volume: {_INT}' "
    f"WHEN k = 3 THEN 'estimated_monthly_volume: {_FRACTION}' END, "
    f"CASE WHEN far THEN 'keyword_difficulty: {_BOUND}' END) AS errors FROM c) "
    "SELECT niche_id, errors, CASE WHEN errors = '' THEN CASE k WHEN 0 THEN 45000 WHEN 1 THEN 9007199254740993 "
    "ELSE 17 END ELSE -1 END::BIGINT AS volume FROM e",
)
def candidates_hostile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Huge, fractional, NaN and out-of-range numbers are errors of their field; 2^53 + 1 stays exact."""
    key = F.col("p_partkey")
    volume = F.get(F.array(*map(F.lit, _VOLUMES)), (key % 6).cast("int"))
    difficulty = F.when(key % 7 == 0, "3000000000").otherwise("12")
    body = F.concat(
        F.lit('{"niche_id":"part-'), key.cast("string"), F.lit('","target_dataset_url":"https://example.gov/a.csv",'
              '"primary_keywords":["a"],"average_cpc":1.5,"data_sources_available":["a","b","c"],'
              '"monetization_vector":"LEAD_GEN","estimated_lead_value":1.0,"uniqueness_potential_ratio":0.8,'
              '"estimated_monthly_volume":'), volume, F.lit(',"keyword_difficulty":'), difficulty, F.lit("}"))
    rows = table(spark, sf_dir, "part").select(key.alias("pos"), F.parse_json(body).alias("candidate"))
    checked = S.validate_candidates(rows)
    fine = F.size("errors") == 0
    return checked.select("niche_id", F.array_join("errors", "; ").alias("errors"),
                          F.when(fine, F.col("estimated_monthly_volume")).otherwise(-1).alias("volume"))
