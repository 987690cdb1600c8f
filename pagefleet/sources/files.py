"""Dataset files, views, profiles and parameterised SQL."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagefleet import schemas
from pagefleet.functions.scalar import sql_type_name
from pagefleet.operators.commits import committed_rows

_IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


class UnsupportedFormat(ValueError):
    """Raised for a suffix outside the supported set."""


class QueryFailed(RuntimeError):
    """One error type for every failure of ``query`` / ``scalar``."""


def reader_for(path: str) -> str:
    """The reader name chosen by lower-cased suffix."""
    lower = path.lower()
    for suffix in schemas.SUPPORTED_SUFFIXES:
        if lower.endswith(suffix):
            return suffix.lstrip(".")
    raise UnsupportedFormat(
        f"unsupported dataset format for {path!r}; supported: {', '.join(schemas.SUPPORTED_SUFFIXES)}"
    )


def open_dataset(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A1: open a CSV/TSV/JSON/NDJSON/Parquet file (or folder) by its suffix.

    CSV/TSV infer the schema unless one is given (inference is an extra pass;
    supply ``schema`` for large inputs). Each ``.json`` file is line-delimited
    records, an array document or one object; ``.ndjson`` is line-delimited only.
    """
    kind = reader_for(path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind in ("csv", "tsv"):
        return reader.options(header=True, inferSchema=schema is None, sep="\t" if kind == "tsv" else ",").csv(path)
    if kind == "ndjson":
        return reader.json(path)
    if kind == "json":
        return _read_json(spark, reader, path, schema)
    return reader.parquet(path)


#: A separator that no JSON text in any Unicode encoding holds, so that a whole file is one line;
#: files above so many bytes are streamed instead (a line has 2 GB at most).
NO_LINE, WHOLE_LINE = "\x00" * 8, 1 << 30


def _read_json(spark: SparkSession, reader, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Each file by its own form: line-delimited if its first line is a whole
    object, else one document (an array of records, or a pretty-printed object)."""
    line = F.regexp_replace("value", "^[\ufeff\\s]+|\\s+$", "")
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), line.alias("line"),
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at")).where("line != ''")
    kind = F.schema_of_variant(F.try_parse_json(F.min_by("line", "at")))
    # One row per file, as many as a listing holds.
    files = lines.groupBy("file").agg(F.coalesce(kind.startswith("OBJECT"), F.lit(False)).alias("by_line"),
                                      F.max("size").alias("size")).collect()
    by_line, whole = (sorted(f["file"] for f in files if f["by_line"] is form) for form in (True, False))
    parts = [reader.json(by_line)] if by_line else []
    if whole:
        # Spark infers the schema of multi-line files in few tasks, however many files there are, and its time
        # grows with their square. As one line each, files are dealt to tasks by size and number.
        large = any(f["size"] > WHOLE_LINE and not f["by_line"] for f in files)
        documents = spark.read if schema is None else spark.read.schema(schema)
        parts.append((documents.option("multiLine", True) if large else documents.option("lineSep", NO_LINE)).json(whole))
    if not parts:
        return reader.json(path)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def register_dataset(spark: SparkSession, name: str, path: str) -> str:
    """A2: expose a file as a named, replaceable temporary view."""
    if not _IDENTIFIER.match(name or ""):
        raise ValueError(f"invalid view name {name!r}: use letters, digits and _, not starting with a digit")
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001 - existence check only
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    if not fs.exists(jvm_path):
        raise FileNotFoundError(f"dataset not found: {path}")
    open_dataset(spark, path).createOrReplaceTempView(name)
    return name


def profile_dataset(df: DataFrame, limit: int = schemas.PROFILE_SAMPLE, order_by: list[str] | None = None
                    ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A3: (column catalogue, stats, sample).

    catalogue = ``column_name, column_type, ordinal, row_count``; the row count
    is one distributed count (Parquet answers it from footers), the column list
    is metadata only. stats = ``row_count, column_count``. sample = the first
    ``limit`` rows in ``order_by`` order.
    """
    spark = df.sparkSession
    cols = spark.createDataFrame(
        [(f.name, sql_type_name(f.dataType), i + 1) for i, f in enumerate(df.schema.fields)],
        "column_name string, column_type string, ordinal int",
    )
    stats = df.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "column_count", F.lit(len(df.columns)).cast("long")
    )
    catalogue = cols.crossJoin(F.broadcast(stats.select("row_count")))
    sample = (df.orderBy(*order_by) if order_by else df).limit(max(limit, 0))
    return catalogue, stats, sample


def query(spark: SparkSession, sql: str, params: dict[str, Any] | None = None) -> DataFrame:
    """Run parameterised SQL over registered views; rows stay a DataFrame."""
    try:
        return spark.sql(sql, args=params or None)
    except Exception as exc:  # noqa: BLE001 - one error type for callers
        raise QueryFailed(str(exc)) from exc


def scalar(spark: SparkSession, sql: str, params: dict[str, Any] | None = None) -> Any:
    """The first column of the first row, ``None`` when empty (an edge action)."""
    rows = query(spark, sql, params).limit(1).collect()
    return rows[0][0] if rows else None


def read_ledger(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The committed rows of one of the fixed-schema ledger tables (empty when never written)."""
    return committed_rows(spark, root, table)


def profile_file(spark: SparkSession, path: str, limit: int = schemas.PROFILE_SAMPLE,
                 order_by: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A3 for a file: as ``profile_dataset``, with ``path`` and ``reader`` in the stats."""
    df = open_dataset(spark, path)
    catalogue, stats, sample = profile_dataset(df, limit, order_by)
    stats = stats.select(F.lit(path).alias("path"), F.lit(reader_for(path)).alias("reader"), "*")
    return catalogue, stats, sample
