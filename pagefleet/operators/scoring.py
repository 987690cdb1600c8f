"""Candidate scoring: validation, classification, leverage score, enrichment.

C1 match_seed, C2 validate_candidates, C3 classify_candidates, C13
needs_enrichment, D4 override_metrics, D5 fill_missing_metrics, E2
representative_keyword, I8 (via functions.scalar), G1 rank_accepted,
H1 pool_candidates, E7 source_reflections.

Raw candidates are a ``VARIANT`` column: key presence matters (an absent key
takes its default, an explicit null fails validation), which typed structs
from ``from_json`` would lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefleet import schemas
from pagefleet.functions import scalar
from pagefleet.operators.verdicts import one_per_request

# --------------------------------------------------------------------------
# fixed values: candidate fields, their kinds and defaults, in model order
# --------------------------------------------------------------------------
# kind: str_req, str_opt, int, float, list, enum
FIELDS = (
    ("niche_id", "str_req", None),
    ("target_dataset_url", "str_req", None),
    ("primary_keywords", "list", []),
    ("estimated_monthly_volume", "int", 0),
    ("average_cpc", "float", 0.0),
    ("keyword_difficulty", "int", 0),
    ("data_sources_available", "list", []),
    ("monetization_vector", "enum", "LEAD_GEN"),
    ("estimated_lead_value", "float", 0.0),
    ("uniqueness_potential_ratio", "float", 0.0),
    ("arbitrage_score", "float", 0.0),
    ("source", "str_opt", None),
)
# (field, lower bound, upper bound)
RANGES = {
    "estimated_monthly_volume": (0, None),
    "average_cpc": (0, None),
    "keyword_difficulty": (0, 100),
    "estimated_lead_value": (0, None),
    "uniqueness_potential_ratio": (0, 1),
}

_INT_TYPES = ("BIGINT", "INT", "SMALLINT", "TINYINT")


def _kind_expr(v: Column, name: str) -> Column:
    """Type name of a field: NULL when absent, 'VOID' for an explicit null."""
    return F.schema_of_variant(F.variant_get(v, f"$.{name}", "variant"))


# Validation runs in two projections: the first extracts, per field, its
# variant type name (_k_), text (_s_) and number (_d_) once; the second builds
# typed values and messages from those columns. One flat expression per field
# keeps the plan small enough for whole-stage codegen.
def _k(name: str) -> Column:
    return F.col(f"_k_{name}")


def _s(name: str) -> Column:
    return F.col(f"_s_{name}")


def _d(name: str) -> Column:
    return F.col(f"_d_{name}")


def _extract(v: Column, name: str) -> list[Column]:
    k = _kind_expr(v, name)
    raw = F.try_variant_get(v, f"$.{name}", "double")
    text = F.try_variant_get(v, f"$.{name}", "string")
    num = (
        F.when(k == "BOOLEAN", F.when(F.try_variant_get(v, f"$.{name}", "boolean"), 1.0).otherwise(0.0))
        .when(k == "STRING", F.trim(text).try_cast("double"))
        .when(k.isin(*_INT_TYPES, "DOUBLE", "FLOAT") | k.startswith("DECIMAL"), raw)
    )
    whole = (  # exact beyond 2^53; null where no 64-bit integer holds it
        F.when(k.isin(*_INT_TYPES), F.try_variant_get(v, f"$.{name}", "bigint"))
        .when(k == "STRING", F.trim(text).try_cast("bigint"))
        .otherwise(num.try_cast("bigint"))
    )
    return [k.alias(f"_k_{name}"), text.alias(f"_s_{name}"), num.alias(f"_d_{name}"), whole.alias(f"_i_{name}")]


def _int_error(name: str) -> Column:
    k, d, text = _k(name), _d(name), F.trim(_s(name))
    return (
        F.when(k.isNull(), F.lit(None))
        .when(k == "VOID", F.lit(schemas.MSG_INT))
        .when(k.isin(*_INT_TYPES, "BOOLEAN"), F.lit(None))
        .when(k == "STRING", F.when(~text.rlike(r"^[+-]?[0-9]+$"), F.lit(schemas.MSG_INT)))
        .when(k.isin("DOUBLE", "FLOAT") | k.startswith("DECIMAL"),
              F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(schemas.MSG_INT))
              .when(d % 1 != 0, F.lit(schemas.MSG_INT_FRACTION)))  # floor would saturate
        .otherwise(F.lit(schemas.MSG_INT))
    )


def _float_error(name: str) -> Column:
    k = _k(name)
    return (
        F.when(k.isNull(), F.lit(None))
        .when(k.isin(*_INT_TYPES, "DOUBLE", "FLOAT", "BOOLEAN") | k.startswith("DECIMAL"), F.lit(None))
        .when(k == "STRING", F.when(_d(name).isNull(), F.lit(schemas.MSG_NUMBER)))
        .otherwise(F.lit(schemas.MSG_NUMBER))
    )


def _str_error(name: str, required: bool) -> Column:
    k = _k(name)
    missing = F.lit(schemas.MSG_REQUIRED) if required else F.lit(None)
    allow_null = F.lit(None) if not required else F.lit(schemas.MSG_STRING)
    return F.when(k.isNull(), missing).when(k == "VOID", allow_null).when(k != "STRING", F.lit(schemas.MSG_STRING))


def _list_errors(v: Column, name: str) -> Column:
    """Errors of a list[str] field: one for a non-list, one per non-string element."""
    k = _k(name)
    arr = F.try_variant_get(v, f"$.{name}", "array<variant>")
    per_elem = F.filter(
        F.transform(
            arr,
            lambda e, i: F.when(
                F.schema_of_variant(e) != "STRING", F.format_string(f"{name}.%d: {schemas.MSG_STRING}", i)
            ),
        ),
        lambda e: e.isNotNull(),
    )
    return (
        F.when(k.isNull(), F.array().cast("array<string>"))
        .when(~k.startswith("ARRAY"), F.array(F.lit(f"{name}: {schemas.MSG_LIST}")))
        .otherwise(per_elem)
    )


def _enum_error(name: str) -> Column:
    k = _k(name)
    return F.when(k.isNull(), F.lit(None)).when(
        (k != "STRING") | ~_s(name).isin(*schemas.MONETIZATION_VECTORS), F.lit(schemas.MSG_ENUM)
    )


def _range_error(value: Column, lo: float | None, hi: float | None) -> Column:
    err = F.lit(None).cast("string")
    # NaN >= 0 is true in Spark but false in Python (Q2): test it explicitly.
    if hi is not None:
        err = F.when(F.isnan(value) | (value > hi), F.lit(schemas.MSG_LE.format(hi))).otherwise(err)
    if lo is not None:
        err = F.when(F.isnan(value) | (value < lo), F.lit(schemas.MSG_GE.format(lo))).otherwise(err)
    return err


def validate_candidates(df: DataFrame, candidate: str = "candidate") -> DataFrame:
    """Typed candidate fields plus ``errors`` (``field: message`` per problem).

    Lax typing (Q1): integer fields take integral numbers and integer
    strings, not ``12.5``; strings never come from numbers. Absent keys take
    their defaults, explicit nulls are errors.
    """
    v = F.col(candidate)
    extracted = df.select("*", *[c for name, _, _ in FIELDS for c in _extract(v, name)])
    typed: list[Column] = []
    errors: list[Column] = []

    def one(name: str, err: Column) -> Column:
        return F.array(F.when(err.isNotNull(), F.concat(F.lit(f"{name}: "), err)))

    for name, kind, default in FIELDS:
        present = _k(name).isNotNull()
        if kind in ("str_req", "str_opt"):
            val = _s(name)
            errors.append(one(name, _str_error(name, kind == "str_req")))
        elif kind == "int":
            val = F.when(present, F.col(f"_i_{name}")).otherwise(F.lit(default).cast("long"))
            err = _int_error(name)
            if name in RANGES:
                given = F.when(present, _d(name)).otherwise(F.lit(float(default)))
                err = F.coalesce(err, _range_error(F.coalesce(val.cast("double"), given), *RANGES[name]))
            err = F.coalesce(err, F.when(present & val.isNull(), F.lit(schemas.MSG_INT)))
            errors.append(one(name, err))
            if name == "keyword_difficulty":
                val = val.try_cast("int")
        elif kind == "float":
            val = F.when(present, _d(name)).otherwise(F.lit(float(default)))
            err = _float_error(name)
            if name in RANGES:
                err = F.coalesce(err, _range_error(val, *RANGES[name]))
            errors.append(one(name, err))
        elif kind == "list":
            val = F.coalesce(F.try_variant_get(v, f"$.{name}", "array<string>"), F.array().cast("array<string>"))
            errors.append(_list_errors(v, name))
        else:  # enum
            val = F.coalesce(_s(name), F.lit(default))
            errors.append(one(name, _enum_error(name)))
        typed.append(val.alias(name))
    all_errors = F.filter(F.flatten(F.array(*errors)), lambda e: e.isNotNull())
    temp = [f"_{p}_{name}" for name, _, _ in FIELDS for p in "ksdi"]
    return extracted.select(*[F.col(c) for c in df.columns], *typed, all_errors.alias("errors")).drop(*temp)


def classify_candidates(
    validated: DataFrame,
    max_difficulty: int = schemas.MAX_DIFFICULTY,
    min_uniqueness: float = schemas.MIN_UNIQUENESS,
) -> DataFrame:
    """``reason`` / ``detail`` by the first failing rule; accepted rows get a score.

    schema_invalid -> keyword_difficulty_too_high (kd > ceiling) ->
    uniqueness_below_threshold (ratio < threshold) -> accepted (reason null).
    Every rejected row is kept.
    """
    invalid = F.size("errors") > 0
    kd = F.col("keyword_difficulty")
    ratio = F.col("uniqueness_potential_ratio")
    reason = (
        F.when(invalid, F.lit("schema_invalid"))
        .when(kd > max_difficulty, F.lit("keyword_difficulty_too_high"))
        .when(ratio < min_uniqueness, F.lit("uniqueness_below_threshold"))
    )
    detail = (
        F.when(invalid, F.array_join("errors", "; "))
        .when(kd > max_difficulty, F.format_string(f"KD %d exceeds ceiling {max_difficulty}", kd))
        .when(ratio < min_uniqueness,
              F.format_string(f"uniqueness %.2f below threshold {min_uniqueness:.2f}", ratio))
    )
    score = scalar.leverage_score(
        "estimated_monthly_volume", "average_cpc", "keyword_difficulty",
        "data_sources_available", "monetization_vector", "estimated_lead_value",
    )
    # Optimizer fence: a filter on ``reason`` (accepted / rejected split) would
    # otherwise be pushed below the validation projections with every alias
    # inlined into the predicate, re-running the variant extraction many times
    # per row. A nondeterministic guard that is always true (and that no rule
    # folds away, unlike comparisons of rand with constants) keeps this
    # projection in place; the value is always ``reason``.
    fenced_reason = F.when(scalar.optimizer_fence(), reason)
    others = [F.col(c) for c in validated.columns if c not in ("reason", "detail", "arbitrage_score")]
    return validated.select(
        *others,
        fenced_reason.alias("reason"),
        detail.alias("detail"),
        F.when(reason.isNull(), score).otherwise(F.col("arbitrage_score")).alias("arbitrage_score"),
    )


def rank_accepted(classified: DataFrame, pos: str = "pos") -> DataFrame:
    """G1: accepted candidates by score desc, stable on input position."""
    return classified.filter(F.col("reason").isNull()).orderBy(F.desc("arbitrage_score"), F.asc(pos))


def match_seed(df: DataFrame, seed: str, niche: str = "niche_id", keywords: str = "primary_keywords") -> DataFrame:
    """Case-insensitive substring of the seed in niche_id or any keyword.

    An empty seed keeps every row; a null niche_id does not match (Q5).
    """
    if not seed:
        return df
    s = seed.lower()
    hit = F.lower(F.col(niche)).contains(s) | F.exists(
        F.coalesce(F.col(keywords), F.array().cast("array<string>")), lambda k: F.lower(k).contains(s)
    )
    return df.filter(F.coalesce(hit, F.lit(False)))


def needs_enrichment(candidate: Column) -> Column:
    """True unless all five scoring keys are present (null-valued keys count)."""
    present = F.lit(True)
    for key in schemas.SCORING_FIELDS:
        present = present & F.variant_get(candidate, f"$.{key}", "variant").isNotNull()
    return ~present


def _as_map(candidate: Column) -> Column:
    return F.try_variant_get(candidate, "$", "map<string,variant>")


def override_metrics(cands: DataFrame, measured: DataFrame, key: str = "niche_id",
                     candidate: str = "candidate") -> DataFrame:
    """Measured volume/cpc/difficulty replace the candidate's values when a
    measurement exists for its key; other candidates pass unchanged.

    ``measured`` has one row per key: ``key, estimated_monthly_volume,
    average_cpc, keyword_difficulty``. It is a shuffle join on the key.
    """
    m = measured.select(
        F.col(key).alias("_mkey"),
        F.to_variant_object(F.struct(
            F.col("estimated_monthly_volume").cast("long").alias("estimated_monthly_volume"),
            F.col("average_cpc").cast("double").alias("average_cpc"),
            F.col("keyword_difficulty").cast("long").alias("keyword_difficulty"),
        )).alias("_measured"),
    )
    joined = cands.join(m, F.col(key) == F.col("_mkey"), "left")
    merged = F.when(
        F.col("_measured").isNull(), F.col(candidate)
    ).otherwise(
        F.to_variant_object(F.map_concat(_as_map(F.col(candidate)), _as_map(F.col("_measured"))))
    )
    return joined.withColumn(candidate, merged).drop("_mkey", "_measured")


def fill_missing_metrics(cands: DataFrame, answers: DataFrame, key: str = "request_key",
                         candidate: str = "candidate") -> DataFrame:
    """For candidates failing C13, add only the keys they lack from the answer.

    ``answers`` has ``key, ok, result`` (VARIANT object). Present keys,
    explicit nulls included, are kept; no or failed answer leaves the row as is;
    an answer that landed more than once counts once (a good one before a failed one).
    """
    if "error" not in answers.columns:
        answers = answers.withColumn("error", F.lit(None).cast("string"))
    a = one_per_request(answers, key).select(F.col(key).alias("_akey"), F.col("ok").alias("_ok"), F.col("result").alias("_ans"))
    joined = cands.join(a, F.col(key) == F.col("_akey"), "left")
    cand_map = _as_map(F.col(candidate))
    ans_map = _as_map(F.col("_ans"))
    absent_only = F.map_filter(ans_map, lambda k, _: ~F.array_contains(F.map_keys(cand_map), k))
    filled = F.to_variant_object(F.map_concat(absent_only, cand_map))
    apply = needs_enrichment(F.col(candidate)) & F.coalesce(F.col("_ok"), F.lit(False)) & ans_map.isNotNull()
    return joined.withColumn(candidate, F.when(apply, filled).otherwise(F.col(candidate))).drop(
        "_akey", "_ok", "_ans"
    )


def representative_keyword(rows: DataFrame, key: str = "niche_id", items: str | None = None) -> DataFrame:
    """Per candidate, the keyword row with the largest numeric volume
    (first on ties) -> volume (int), cpc USD ``round(cents/100, 2)``, difficulty
    (``difficulty``, falling through to ``keyword_difficulty`` when falsy).

    ``rows``: ``key, pos, keyword, volume, cpc, difficulty, keyword_difficulty``
    with text or numeric values, or ``key`` and a list column ``items`` of such rows (a key
    may have several lists; ``pos`` counts across them). A list gives its best row before
    anything is sorted or shuffled; then a partial+final aggregate per key: a hot
    candidate is combined map-side.
    """
    def ranked(row: Column) -> Column:
        return F.struct(scalar.to_number(row["volume"]).alias("v"), (-row["pos"]).alias("p"), row.alias("r"))

    if items is None:
        row = F.struct(*[c for c in ("keyword", "cpc", "difficulty", "keyword_difficulty", "difficulty_truthy")
                         if c in rows.columns])
        found = rows.select(key, F.struct(scalar.to_number("volume").alias("v"), (-F.col("pos")).alias("p"),
                                          row.alias("r")).alias("b"))
    else:
        found = rows.select(key, F.array_max(F.transform(F.col(items), ranked)).alias("b"))
    # Lists without rows are left out last: a filter before would be pushed down and rank every list twice.
    best = found.groupBy(key).agg(F.max_by("b", F.struct("b.v", "b.p")).alias("b")).where(F.col("b").isNotNull())
    best = best.select(key, "b.v", "b.r.*")
    diff_primary = scalar.to_number("difficulty")
    # ``difficulty or keyword_difficulty`` (Q17): with raw JSON rows the
    # parser supplies ``difficulty_truthy``; typed rows fall through on 0/null.
    primary_set = F.col("difficulty_truthy") if "difficulty_truthy" in best.columns else (diff_primary != 0)
    diff = F.when(primary_set, diff_primary).otherwise(scalar.to_number("keyword_difficulty"))
    return best.select(
        key,
        "keyword",
        F.col("v").try_cast("long").alias("estimated_monthly_volume"),
        scalar.cents_to_usd(scalar.to_number("cpc")).alias("average_cpc"),
        diff.try_cast("long").alias("keyword_difficulty"),
    )


def pool_candidates(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """H1: bag union of every source's candidates in source order (no dedup).

    Adds ``source_ordinal``; missing columns are filled with nulls.
    """
    out = None
    for ordinal, (source_id, df) in enumerate(sources):
        tagged = df.withColumn("source_ordinal", F.lit(ordinal)).withColumn("source_id", F.lit(source_id))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("pool_candidates needs at least one source")
    return out


def source_reflections(pool: DataFrame, errors: DataFrame | None = None, sources: list[str] | None = None) -> DataFrame:
    """Per source ``ok, candidate_count, error``; failing sources do not stop others.

    ``errors``: ``source_id, error`` rows of sources that failed. ``sources``
    names every source that ran: one without candidates and without an error
    has a row of its own, with a count of zero.
    """
    found = pool.groupBy("source_id").agg(F.count(F.lit(1)).alias("candidate_count"))
    spark = pool.sparkSession
    if errors is None:
        errors = spark.createDataFrame([], "source_id string, error string")
    bad = errors.select("source_id", F.col("error").cast("string"))
    if sources is None:
        known = found.select("source_id").unionByName(bad.select("source_id")).distinct()
    else:
        known = spark.createDataFrame([(s,) for s in sources], "source_id string")
    rows = known.join(found, "source_id", "left").join(bad.withColumn("_bad", F.lit(True)), "source_id", "left")
    return rows.select("source_id", F.col("_bad").isNull().alias("ok"),
                       F.coalesce("candidate_count", F.lit(0)).cast("long").alias("candidate_count"), "error")


def candidate_variant(df: DataFrame, fields: list[str], keep_nulls: bool = False) -> Column:
    """Candidate VARIANT from typed columns; null fields are absent keys
    unless ``keep_nulls`` (then they are explicit nulls)."""
    st = F.struct(*[F.col(f) for f in fields])
    if keep_nulls:
        return F.to_variant_object(st)
    return F.parse_json(F.to_json(st))
