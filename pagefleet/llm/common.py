"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from pagefleet.session import scratch_dir

#: The characters that separate words, as a regular-expression class body.
SPACES = r" \t\n\x0B\f\r"


def spool(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that were running, never
    the work below the written table. Null-typed columns are not supported.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def offsets_of(totals: DataFrame, order: list[str], size: str, out: str) -> DataFrame:
    """Exclusive prefix sum of ``size`` over ``order``.

    ``totals`` has one row per input partition or file, never one per document,
    so the single-partition window sorts a bounded list.
    """
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*order, F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long").alias(out))


def documents_only(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns; extra columns of any name are left behind."""
    return docs.select(*columns)


def crc_bucket(doc_id, buckets: int):
    """crc32 of the id's decimal text modulo ``buckets`` (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % buckets
