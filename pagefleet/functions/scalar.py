"""Scalar math, cell coercion and JSON helpers (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagefleet import schemas

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------
# scoring math
# --------------------------------------------------------------------------
def leverage_score(
    volume: ColumnOrName,
    cpc: ColumnOrName,
    difficulty: ColumnOrName,
    sources: ColumnOrName,
    vector: ColumnOrName,
    lead_value: ColumnOrName,
) -> Column:
    """I8: ``round(volume*cpc / (max(kd,1) * penalty) * multiplier, 2)``.

    penalty is 2.5 when fewer than three sources are listed (array length, not
    distinct); multiplier is 3.5 + lead/100 for LEAD_GEN, 2.0 for
    HIGH_TICKET_AFFILIATE, else 1.
    """
    kd = F.greatest(_col(difficulty).cast("double"), F.lit(1.0))
    penalty = F.when(F.size(_col(sources)) < schemas.FEW_SOURCES, F.lit(schemas.FEW_SOURCES_PENALTY)).otherwise(1.0)
    vec = _col(vector)
    multiplier = (
        F.when(vec == "LEAD_GEN", F.lit(schemas.LEAD_GEN_BASE) + _col(lead_value) / F.lit(100.0))
        .when(vec == "HIGH_TICKET_AFFILIATE", F.lit(schemas.HIGH_TICKET_MULTIPLIER))
        .otherwise(F.lit(1.0))
    )
    traffic = _col(volume).cast("double") * _col(cpc).cast("double")
    return F.round(traffic / (kd * penalty) * multiplier, 2)


def ctr(clicks: ColumnOrName, impressions: ColumnOrName, digits: int | None = None) -> Column:
    """Clicks / impressions, 0.0 when impressions is 0; optionally rounded."""
    imp = _col(impressions)
    ratio = F.when(imp > 0, _col(clicks).cast("double") / imp.cast("double")).otherwise(F.lit(0.0))
    return F.round(ratio, digits) if digits is not None else ratio


def to_number(c: ColumnOrName) -> Column:
    """A finite float, or 0.0 when absent, not numeric, NaN or infinite."""
    x = _col(c).cast("string").try_cast("double")
    return F.when(F.abs(x) < float("inf"), x).otherwise(F.lit(0.0))


def cents_to_usd(c: ColumnOrName) -> Column:
    """Cents -> USD, ``round(x / 100, 2)``."""
    return F.round(_col(c).cast("double") / F.lit(100.0), 2)


def verdict(confidence: ColumnOrName, threshold: float = schemas.MIN_CONFIDENCE) -> Column:
    """I23: 'approved' iff confidence >= threshold, else 'rejected'."""
    return F.when(_col(confidence) >= threshold, F.lit("approved")).otherwise(F.lit("rejected"))


def stamp() -> Column:
    """The current UTC time (session time zone is UTC)."""
    return F.current_timestamp()


def optimizer_fence() -> Column:
    """An always-true, nondeterministic predicate that no optimizer rule folds
    away. And-ed into a filter (or guarding a projected value), it keeps that
    step where it is written: Catalyst does not push nondeterministic
    predicates below projections or aggregates. Used where pushing down would
    *add* work (a per-group test re-run per row, or a large projection
    inlined into a pushed predicate)."""
    return F.monotonically_increasing_id() >= F.lit(0)


# --------------------------------------------------------------------------
# JSON list codec
# --------------------------------------------------------------------------
def json_list_decode(c: ColumnOrName) -> Column:
    """JSON text list -> array<string>; null/empty/invalid -> []."""
    parsed = F.from_json(_col(c), T.ArrayType(T.StringType()))
    return F.coalesce(parsed, F.array().cast(T.ArrayType(T.StringType())))


def json_list_encode(c: ColumnOrName) -> Column:
    """array<string> -> JSON text; null -> '[]'."""
    return F.coalesce(F.to_json(_col(c)), F.lit("[]"))


# --------------------------------------------------------------------------
# cell coercion (I11, I12) and cell text
# --------------------------------------------------------------------------
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric_type(dt: T.DataType) -> bool:
    """Q12: whole type names, not substrings (INTERVAL is not numeric)."""
    return isinstance(dt, _NUMERIC)


def sql_type_name(dt: T.DataType) -> str:
    """Standard SQL spelling of a Spark type (catalogue output of A3)."""
    simple = {
        T.ByteType: "TINYINT", T.ShortType: "SMALLINT", T.IntegerType: "INTEGER",
        T.LongType: "BIGINT", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE",
        T.StringType: "VARCHAR", T.BooleanType: "BOOLEAN", T.DateType: "DATE",
        T.TimestampType: "TIMESTAMP WITH TIME ZONE", T.TimestampNTZType: "TIMESTAMP",
        T.BinaryType: "BLOB",
    }
    for cls, name in simple.items():
        if isinstance(dt, cls):
            return name
    if isinstance(dt, T.DecimalType):
        return f"DECIMAL({dt.precision},{dt.scale})"
    if isinstance(dt, T.ArrayType):
        return sql_type_name(dt.elementType) + "[]"
    return dt.simpleString().upper()


def _iso_timestamp(col: Column) -> Column:
    # Python isoformat: seconds always, fraction only when non-zero.
    frac = F.date_format(col, "SSSSSS")
    base = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(frac == "000000", base).otherwise(F.concat(base, F.lit("."), frac))


def json_number(col: Column) -> Column:
    """A decimal as a JSON number (VARIANT) of its full precision, without trailing zeros: 5.00 is 5."""
    plain = col.cast("string")
    return F.parse_json(F.when(F.contains(plain, F.lit(".")), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain))


def json_safe(col: Column, dt: T.DataType) -> Column:
    """NaN/±Inf -> null, dates -> ISO text, binary -> UTF-8 text, decimals -> JSON numbers.

    Follows the schema into structs, arrays and maps, at any depth. Map keys are
    their cell texts (a key that has none is the text ``null``).
    """
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(col) | (F.abs(col) == float("inf")), F.lit(None).cast(dt)).otherwise(col)
    if isinstance(dt, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return _iso_timestamp(col)
    if isinstance(dt, T.BinaryType):
        return F.make_valid_utf8(col.cast("string"))
    if isinstance(dt, T.DecimalType):
        return json_number(col)
    if isinstance(dt, T.StructType):
        fields = [json_safe(col.getField(f.name), f.dataType).alias(f.name) for f in dt.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(dt, T.ArrayType):
        return F.transform(col, lambda x: json_safe(x, dt.elementType))
    if isinstance(dt, T.MapType):
        return F.map_from_entries(F.transform(F.map_entries(col), lambda e: F.struct(
            F.coalesce(cell_text(e["key"], dt.keyType), F.lit("null")).alias("key"),
            json_safe(e["value"], dt.valueType).alias("value"))))
    return col


def cell_text(col: Column, dt: T.DataType) -> Column:
    """``str(sanitised cell)`` as used for route keys and labels (Q6, Q21)."""
    if isinstance(dt, T.BooleanType):
        return F.when(col, F.lit("True")).when(~col, F.lit("False"))
    if isinstance(dt, T.DecimalType):
        return F.when(col == F.floor(col), col.cast("decimal(38,0)").cast("string")).otherwise(col.cast("double").cast("string"))
    if isinstance(dt, (T.StructType, T.ArrayType, T.MapType)):
        return col.cast("string")
    return json_safe(col, dt).cast("string")


def json_safe_frame(df: DataFrame) -> DataFrame:
    """I11 over every column of a frame."""
    return df.select([json_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def strict_json(c: Column) -> Column:
    """JSON text that keeps null fields and never holds NaN/Infinity tokens
    (callers pass columns through ``json_safe`` first, or use ``json_text``)."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def json_text(df: DataFrame) -> Column:
    """I12 of a whole row: the strict JSON object of its cells, nested ones included."""
    return strict_json(F.struct(*[json_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]))


def calculator_value(df: DataFrame, inputs: list[tuple[str, float]], base: float = 0.0) -> Column:
    """I16: ``base + Σ value*weight``; non-numeric, NaN or null cells count as 0."""
    total: Column = F.lit(float(base))
    for key, weight in inputs:
        v = F.col(f"`{key}`").cast("string").try_cast("double")
        v = F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))
        total = total + v * F.lit(float(weight))
    return total
