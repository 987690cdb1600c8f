"""Many documents in few container files, found by an index of byte ranges.

The lines of all documents are range partitioned by (keys, order), and each
partition is one container: its documents one behind the other, lines ended by
``\\n``. The number of files follows the data's size, not the number of
documents, and a document that holds a large share of all lines lies in
several containers, one behind the other. Beside them an index, sorted by the
keys, has a row for each document and container: ``keys..., container, offset,
length, lines``.

Spark's committer writes both, the index last, so what an index names is
there. A lookup prunes the index by its keys and reads the byte ranges it names.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagefleet.session import checkpointed


def write_documents(lines: DataFrame, root: str, keys: list[str], order: list[str], line: str = "line",
                    partitions: int | None = None) -> None:
    """Write the documents that ``keys`` name, each with its lines in ``order``.

    A null line is an empty one; null keys name a document like any other.
    """
    n = int(partitions or lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.select(*keys, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                        F.coalesce(F.col(line), F.lit("")).alias("_line"))
    by = [*keys, *[f"_o{i}" for i in range(len(order))]]
    # Cut here: containers and index must see the same partitions.
    staged = checkpointed(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).select(
        *keys, "_line", F.spark_partition_id().alias("container"), F.monotonically_increasing_id().alias("_row")))
    staged.select("_line").write.option("maxRecordsPerFile", 0).text(f"{root.rstrip('/')}/data")
    size = (F.octet_length("_line") + 1).cast("long")
    # One container's rows at a time, without their text.
    before = Window.partitionBy("container").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = staged.select(*keys, "container", "_row", size.alias("_size")).withColumn(
        "offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    index = placed.groupBy(*keys, "container").agg(
        F.min("offset").alias("offset"), F.sum("_size").alias("length"), F.count(F.lit(1)).alias("lines"))
    index.repartitionByRange(*keys).sortWithinPartitions(*keys, "container").write.parquet(f"{root.rstrip('/')}/index")


def document_index(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/index")


def read_document(spark: SparkSession, root: str, **key: Any) -> bytes | None:
    """The bytes of one document (None where there is none): only its byte ranges are read.

    An edge action like ``scalar``: the document comes to the driver.
    """
    rows = document_index(spark, root)
    for name, value in key.items():
        rows = rows.where(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    # One row for each container that holds some of the document.
    ranges = rows.select("container", "offset", "length").orderBy("container").collect()
    if not ranges:
        return None
    jvm = spark._jvm  # noqa: SLF001 - positioned reads
    data = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/data")
    fs = data.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    out = []
    for r in ranges:
        (found,) = fs.globStatus(jvm.org.apache.hadoop.fs.Path(data, f"part-{r['container']:05d}-*"))
        stream = fs.open(found.getPath())
        try:
            stream.seek(r["offset"])
            out.append(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, r["length"])))
        finally:
            stream.close()
    return b"".join(out)
