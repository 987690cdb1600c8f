"""Running counts within groups of any size: range partitions plus offsets.

A window over a group puts the group into one task. Here rows are range
partitioned by (group, order), so a group with a large share of all rows is
spread over as many tasks as its share; each task counts its own part, and
the parts before it, one row for each (group, partition), are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefleet.session import checkpointed


def running_count(rows: DataFrame, group: str, order: list[Column], counted: Column, out: str,
                  partitions: int | None = None) -> DataFrame:
    """``rows`` with ``out``: how many rows of the group up to and including this one, in ``order``, are ``counted``.

    A null group is a group. Rows that tie in ``order`` come in any order. The
    ranged rows are checkpointed, so that counts and offsets see one partitioning.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("_rc_counted", counted.cast("long")).repartitionByRange(n, F.col(group), *order)
    ranged = checkpointed(ranged.withColumn("_rc_part", F.spark_partition_id()))
    own = Window.partitionBy("_rc_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counts = ranged.withColumn("_rc_here", F.sum("_rc_counted").over(own))
    # As many rows for a group as partitions that hold some of it.
    before = Window.partitionBy("_rc_group").orderBy("_rc_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(F.col(group).alias("_rc_group"), F.col("_rc_part").alias("_rc_at")).agg(F.sum("_rc_counted").alias("_rc_n")) \
        .withColumn("_rc_before", F.coalesce(F.sum("_rc_n").over(before), F.lit(0))).drop("_rc_n")
    same = counts[group].eqNullSafe(offsets["_rc_group"]) & (counts["_rc_part"] == offsets["_rc_at"])
    return counts.join(offsets, same).select(*rows.columns, (F.col("_rc_here") + F.col("_rc_before")).alias(out))


def first_per_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, for any ``n``.

    Up to Spark's window group limit a group ships at most ``n`` rows from each
    map task. Beyond it a window would sort a whole group in one task; there the rows are
    counted over range partitions instead.
    """
    if n <= int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        number = F.row_number().over(Window.partitionBy(group).orderBy(*order))
        return rows.withColumn("_n", number).where(F.col("_n") <= n).drop("_n")
    return running_count(rows, group, order, F.lit(1), "_n").where(F.col("_n") <= n).drop("_n")
