"""Candidate queries over the driver tables.

Candidates are derived from ``part ⋈ lineitem``: volume = line count, cpc =
largest extended price / 1000, difficulty = part size, data sources = a
prefix of a fixed list sized by ``p_size % 5``, vector by part type, lead value
= retail price / 10, uniqueness = ``(p_partkey % 125) / 100`` (values above 1
are schema-invalid, below 0.6 are rejected). The same derivation is the CTE of
every oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefleet.operators import scoring as S
from pagefleet.plans.registry import register, table
from pagefleet.plans.route_queries import WORD_SPLIT
from pagefleet.session import spread

SOURCE_LIST = ["csv", "json", "parquet", "api"]

_CAND_CTE = """
li AS (SELECT l_partkey, count(*) AS n_lines, max(l_extendedprice) AS max_price FROM lineitem GROUP BY l_partkey),
cand AS (
  SELECT p.p_partkey AS pos,
         p.p_name || ' #' || CAST(p.p_partkey AS VARCHAR) AS niche_id,
         'https://data.example.org/parts/' || CAST(p.p_partkey AS VARCHAR) || '.csv' AS target_dataset_url,
         string_split(p.p_name, ' ') AS primary_keywords,
         CAST(coalesce(li.n_lines, 0) AS BIGINT) AS estimated_monthly_volume,
         coalesce(li.max_price, 0.0) / 1000.0 AS average_cpc,
         p.p_size AS keyword_difficulty,
         list_slice(['csv', 'json', 'parquet', 'api'], 1, p.p_size % 5) AS data_sources_available,
         CASE p.p_type WHEN 'ECONOMY' THEN 'LEAD_GEN' WHEN 'SMALL' THEN 'HIGH_TICKET_AFFILIATE' ELSE 'PER_CLICK' END
           AS monetization_vector,
         round(p.p_retailprice / 10.0, 2) AS estimated_lead_value,
         round((p.p_partkey % 125) / 100.0, 2) AS uniqueness_potential_ratio,
         'catalog' AS source
  FROM part p LEFT JOIN li ON li.l_partkey = p.p_partkey
)"""

_SCORE_SQL = """round(CAST(estimated_monthly_volume AS DOUBLE) * average_cpc
      / (greatest(CAST(keyword_difficulty AS DOUBLE), 1.0) * CASE WHEN len(data_sources_available) < 3 THEN 2.5 ELSE 1.0 END)
      * CASE monetization_vector WHEN 'LEAD_GEN' THEN 3.5 + estimated_lead_value / 100.0
                                 WHEN 'HIGH_TICKET_AFFILIATE' THEN 2.0 ELSE 1.0 END, 2)"""

_REASON_SQL = """CASE WHEN uniqueness_potential_ratio > 1 THEN 'schema_invalid'
            WHEN keyword_difficulty > 35 THEN 'keyword_difficulty_too_high'
            WHEN uniqueness_potential_ratio < 0.6 THEN 'uniqueness_below_threshold' END"""

_DETAIL_SQL = """CASE WHEN uniqueness_potential_ratio > 1
              THEN 'uniqueness_potential_ratio: Input should be less than or equal to 1'
            WHEN keyword_difficulty > 35 THEN 'KD ' || CAST(keyword_difficulty AS VARCHAR) || ' exceeds ceiling 35'
            WHEN uniqueness_potential_ratio < 0.6
              THEN 'uniqueness ' || printf('%.2f', uniqueness_potential_ratio) || ' below threshold 0.60' END"""


def part_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed candidate columns from ``part ⋈ lineitem`` (one row per part)."""
    part = spread(table(spark, sf_dir, "part"))
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.max("l_extendedprice").alias("max_price")
    )
    vec = (F.when(F.col("p_type") == "ECONOMY", "LEAD_GEN")
           .when(F.col("p_type") == "SMALL", "HIGH_TICKET_AFFILIATE").otherwise("PER_CLICK"))
    return part.join(li, part.p_partkey == li.l_partkey, "left").select(
        F.col("p_partkey").alias("pos"),
        F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")).alias("niche_id"),
        F.concat(F.lit("https://data.example.org/parts/"), F.col("p_partkey").cast("string"), F.lit(".csv"))
        .alias("target_dataset_url"),
        F.split("p_name", " ").alias("primary_keywords"),
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("estimated_monthly_volume"),
        (F.coalesce("max_price", F.lit(0.0)) / 1000.0).alias("average_cpc"),
        F.col("p_size").alias("keyword_difficulty"),
        F.slice(F.array(*[F.lit(s) for s in SOURCE_LIST]), 1, F.col("p_size") % 5).alias("data_sources_available"),
        vec.alias("monetization_vector"),
        F.round(F.col("p_retailprice") / 10.0, 2).alias("estimated_lead_value"),
        F.round((F.col("p_partkey") % 125) / 100.0, 2).alias("uniqueness_potential_ratio"),
        F.lit("catalog").alias("source"),
    )


CAND_FIELDS = [n for n, _, _ in S.FIELDS if n != "arbitrage_score"]


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    cands = part_candidates(spark, sf_dir)
    raw = cands.select("pos", S.candidate_variant(cands, CAND_FIELDS).alias("candidate"))
    return S.classify_candidates(S.validate_candidates(raw))


@register(
    "candidates_scored",
    f"WITH {_CAND_CTE} SELECT niche_id, estimated_monthly_volume, average_cpc, keyword_difficulty, "
    f"{_SCORE_SQL} AS arbitrage_score FROM cand WHERE ({_REASON_SQL}) IS NULL",
)
def candidates_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted candidates with their leverage score (the ranked
    order, G1, is ``top_candidates``; a full global sort adds nothing to a
    result set)."""
    accepted = _classified(spark, sf_dir).filter(F.col("reason").isNull())
    return accepted.select("niche_id", "estimated_monthly_volume", "average_cpc",
                           "keyword_difficulty", "arbitrage_score")


@register(
    "candidates_rejected",
    f"WITH {_CAND_CTE} SELECT niche_id, {_REASON_SQL} AS reason, {_DETAIL_SQL} AS detail "
    f"FROM cand WHERE ({_REASON_SQL}) IS NOT NULL",
)
def candidates_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rejected candidate with reason and detail (none dropped)."""
    return _classified(spark, sf_dir).filter(F.col("reason").isNotNull()).select("niche_id", "reason", "detail")


@register(
    "top_candidates",
    f"WITH {_CAND_CTE}, s AS (SELECT niche_id, pos, {_SCORE_SQL} AS arbitrage_score FROM cand "
    f"WHERE ({_REASON_SQL}) IS NULL) SELECT niche_id, arbitrage_score FROM s "
    f"ORDER BY arbitrage_score DESC, pos ASC LIMIT 10",
)
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best accepted candidates (stable on input position)."""
    return S.rank_accepted(_classified(spark, sf_dir)).limit(10).select("niche_id", "arbitrage_score")


@register(
    "seed_match",
    f"WITH {_CAND_CTE} SELECT niche_id FROM cand WHERE contains(lower(niche_id), 'ring') "
    f"OR len(list_filter(primary_keywords, lambda k: contains(lower(k), 'ring'))) > 0",
)
def seed_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose niche id or any keyword contains the seed."""
    return S.match_seed(part_candidates(spark, sf_dir), "RING").select("niche_id")


def supplier_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = table(spark, sf_dir, "supplier")
    return sup.select(
        F.col("s_suppkey").alias("pos"),
        F.col("s_name").alias("niche_id"),
        F.concat(F.lit("https://registry.example.org/"), F.col("s_suppkey").cast("string")).alias("target_dataset_url"),
    )


@register(
    "pool_union",
    f"WITH {_CAND_CTE} SELECT niche_id, 'catalog' AS source_id, 0 AS source_ordinal FROM cand "
    "UNION ALL SELECT s_name AS niche_id, 'registry' AS source_id, 1 AS source_ordinal FROM supplier",
)
def pool_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: bag union of two sources in source order, no de-duplication."""
    pool = S.pool_candidates([
        ("catalog", part_candidates(spark, sf_dir)),
        ("registry", supplier_candidates(spark, sf_dir)),
    ])
    return pool.select("niche_id", "source_id", "source_ordinal")


@register(
    "source_reflections",
    f"WITH {_CAND_CTE} SELECT 'catalog' AS source_id, true AS ok, count(*) AS candidate_count, "
    "CAST(NULL AS VARCHAR) AS error FROM cand UNION ALL SELECT 'registry', true, count(*), NULL FROM supplier",
)
def source_reflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source ok flag, candidate count and error text."""
    pool = S.pool_candidates([
        ("catalog", part_candidates(spark, sf_dir)),
        ("registry", supplier_candidates(spark, sf_dir)),
    ])
    return S.source_reflections(pool)


_MEASURED_CTE = """
measured AS (
  SELECT p.p_name || ' #' || CAST(p.p_partkey AS VARCHAR) AS niche_id,
         CAST(count(*) AS BIGINT) AS m_volume,
         max(l.l_extendedprice) / 100.0 AS m_cpc,
         CAST(max(l.l_linenumber) AS BIGINT) AS m_kd
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  WHERE l.l_returnflag = 'R'
  GROUP BY p.p_partkey, p.p_name
)"""


def measured_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured keyword metrics per candidate: returned line items of the part."""
    part = table(spark, sf_dir, "part")
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    agg = li.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("estimated_monthly_volume"),
        (F.max("l_extendedprice") / 100.0).alias("average_cpc"),
        F.max("l_linenumber").cast("long").alias("keyword_difficulty"),
    )
    return agg.join(part, agg.l_partkey == part.p_partkey).select(
        F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")).alias("niche_id"),
        "estimated_monthly_volume", "average_cpc", "keyword_difficulty",
    )


@register(
    "enrich_override",
    f"WITH {_CAND_CTE}, {_MEASURED_CTE} "
    "SELECT c.niche_id, coalesce(m.m_volume, c.estimated_monthly_volume) AS estimated_monthly_volume, "
    "coalesce(m.m_cpc, c.average_cpc) AS average_cpc, "
    "CAST(coalesce(m.m_kd, c.keyword_difficulty) AS INTEGER) AS keyword_difficulty "
    "FROM cand c LEFT JOIN measured m ON c.niche_id = m.niche_id",
)
def enrich_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured metrics replace candidate values where a measurement exists."""
    cands = part_candidates(spark, sf_dir)
    raw = cands.select("niche_id", S.candidate_variant(cands, CAND_FIELDS).alias("candidate"))
    merged = S.override_metrics(raw, measured_metrics(spark, sf_dir))
    return S.validate_candidates(merged.drop("niche_id")).select(
        "niche_id", "estimated_monthly_volume", "average_cpc", "keyword_difficulty"
    )


_ANSWER_CTE = """
answers AS (
  SELECT p.p_name || ' #' || CAST(p.p_partkey AS VARCHAR) AS niche_id,
         round(sum(l.l_tax), 2) AS a_lead, max(l.l_discount) * 10.0 AS a_ratio, 99.0 AS a_cpc
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY p.p_partkey, p.p_name
),
partial AS (
  SELECT niche_id, average_cpc,
         CASE WHEN monetization_vector = 'PER_CLICK' THEN NULL ELSE estimated_lead_value END AS lead,
         CASE WHEN keyword_difficulty > 40 THEN NULL ELSE uniqueness_potential_ratio END AS ratio
  FROM cand
)"""


def partial_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates lacking keys: PER_CLICK rows have no lead value, sizes above
    40 have no uniqueness ratio (absent keys, not nulls)."""
    c = part_candidates(spark, sf_dir)
    return c.withColumn(
        "estimated_lead_value",
        F.when(F.col("monetization_vector") != "PER_CLICK", F.col("estimated_lead_value")),
    ).withColumn(
        "uniqueness_potential_ratio",
        F.when(F.col("keyword_difficulty") <= 40, F.col("uniqueness_potential_ratio")),
    )


def metric_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer objects per candidate (``request_key, ok, result``)."""
    part = table(spark, sf_dir, "part")
    li = table(spark, sf_dir, "lineitem")
    agg = li.groupBy("l_partkey").agg(
        F.round(F.sum("l_tax"), 2).alias("estimated_lead_value"),
        (F.max("l_discount") * 10.0).alias("uniqueness_potential_ratio"),
    )
    return agg.join(part, agg.l_partkey == part.p_partkey).select(
        F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")).alias("request_key"),
        F.lit(True).alias("ok"),
        F.to_variant_object(F.struct(
            "estimated_lead_value", "uniqueness_potential_ratio", F.lit(99.0).alias("average_cpc")
        )).alias("result"),
    )


@register(
    "enrich_fill",
    f"WITH {_CAND_CTE}, {_ANSWER_CTE} "
    "SELECT p.niche_id, (p.lead IS NULL OR p.ratio IS NULL) AS needs_enrichment, "
    "CASE WHEN p.lead IS NULL AND a.niche_id IS NOT NULL THEN a.a_lead ELSE p.lead END "
    "  AS estimated_lead_value_raw, "
    "CASE WHEN p.ratio IS NULL AND a.niche_id IS NOT NULL THEN a.a_ratio ELSE p.ratio END AS uniqueness_potential_ratio_raw, "
    "p.average_cpc FROM partial p LEFT JOIN answers a ON p.niche_id = a.niche_id",
)
def enrich_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only absent scoring keys are filled from the answer; present keys
    (here average_cpc) keep the candidate's value."""
    cands = partial_candidates(spark, sf_dir)
    raw = cands.select(F.col("niche_id").alias("request_key"),
                       S.candidate_variant(cands, CAND_FIELDS).alias("candidate"))
    flagged = raw.withColumn("needs_enrichment", S.needs_enrichment(F.col("candidate")))
    filled = S.fill_missing_metrics(flagged, metric_answers(spark, sf_dir))
    c = F.col("candidate")
    return filled.select(
        F.try_variant_get(c, "$.niche_id", "string").alias("niche_id"),
        "needs_enrichment",
        F.try_variant_get(c, "$.estimated_lead_value", "double").alias("estimated_lead_value_raw"),
        F.try_variant_get(c, "$.uniqueness_potential_ratio", "double").alias("uniqueness_potential_ratio_raw"),
        F.try_variant_get(c, "$.average_cpc", "double").alias("average_cpc"),
    )


_KEYWORD_CTE = f"""
kw AS (
  SELECT doc_id, word AS keyword, pos,
         length(word) AS volume, ascii(word) * 10 AS cpc,
         length(word) % 4 AS difficulty, pos % 3 AS keyword_difficulty
  FROM (
    SELECT doc_id, unnest(parts) AS word, unnest(range(len(parts))) AS pos
    FROM (SELECT doc_id, string_split_regex(text, '{WORD_SPLIT}') AS parts FROM documents)
  ) WHERE word <> ''
),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY volume DESC, pos ASC) AS rn FROM kw
)"""


LIST_ROWS = 500  # keyword rows of one list, payload or landed document (bounded, their count grows with data)


def keyword_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword-overview rows: every word of every document is a keyword of its doc.

    ``doc_id, chunk, items``, a list for each range of ``LIST_ROWS`` word positions: the rows
    stay inside their document's row, so that none of them is sorted or shuffled.
    """
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).where(F.col("text").isNotNull())
    words = docs.select("doc_id", F.split("text", WORD_SPLIT).alias("words"))
    last = F.floor((F.size("words") - 1) / LIST_ROWS).cast("int")
    lists = words.select("doc_id", F.posexplode(F.transform(
        F.sequence(F.lit(0), last), lambda n: F.slice("words", n * LIST_ROWS + 1, LIST_ROWS))).alias("chunk", "words"))

    def keyword(word: Column, n: Column) -> Column:
        pos = F.col("chunk") * LIST_ROWS + n
        return F.struct(
            word.alias("keyword"), pos.alias("pos"), F.length(word).alias("volume"),
            (F.ascii(word) * 10).alias("cpc"), (F.length(word) % 4).alias("difficulty"),
            (pos % 3).alias("keyword_difficulty"))

    # Asked of the words: a filter on ``items`` would be pushed down and build them twice.
    some = lists.where(F.exists("words", lambda w: w != ""))
    return some.select("doc_id", "chunk", F.filter(
        F.transform("words", keyword), lambda r: r["keyword"] != "").alias("items"))


@register(
    "best_keyword",
    f"WITH {_KEYWORD_CTE} SELECT doc_id, keyword, CAST(volume AS BIGINT) AS estimated_monthly_volume, "
    "round(cpc / 100.0, 2) AS average_cpc, "
    "CAST(CASE WHEN difficulty <> 0 THEN difficulty ELSE keyword_difficulty END AS BIGINT) AS keyword_difficulty "
    "FROM best WHERE rn = 1",
)
def best_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the highest-volume keyword (first on ties)."""
    return S.representative_keyword(keyword_lists(spark, sf_dir), key="doc_id", items="items")
