"""Row exploration: C7 search_rows and G9 sort_rows (the directory table's data logic)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagefleet.functions.scalar import is_numeric_type


def search_rows(df: DataFrame, needle: str) -> DataFrame:
    """Case-insensitive substring over every column; the needle is trimmed
    and an empty needle keeps every row. Null cells never match (Q5)."""
    q = (needle or "").strip().lower()
    if not q:
        return df
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    return df.filter(F.exists(cells, lambda x: F.coalesce(F.lower(x).contains(q), F.lit(False))))


def search_count(df: DataFrame, needle: str) -> DataFrame:
    """The result count shown next to the search box."""
    return search_rows(df, needle).agg(F.count(F.lit(1)).alias("results"))


def sort_rows(df: DataFrame, key: str | None = None, ascending: bool = True) -> DataFrame:
    """Order by one column; numbers compare as numbers, everything else as
    text; the default key is the first column, ascending. A distributed range
    sort, not a driver sort."""
    key = key or df.columns[0]
    dt = df.schema[key].dataType
    k = F.col(f"`{key}`") if is_numeric_type(dt) else F.col(f"`{key}`").cast(T.StringType())
    return df.orderBy(k.asc() if ascending else k.desc())
