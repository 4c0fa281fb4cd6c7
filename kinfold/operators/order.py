"""Arrival numbers and running totals that never put one key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.session import cut

# A group up to this many rows may be ordered inside one task.
ORDERED_GROUP_ROWS = 1_000_000


def number_records(
    records: DataFrame, *order: str, name: str = "record_no", start: int = 0
) -> DataFrame:
    """Give every record a number that increases in arrival order (gaps are allowed).

    The numbers come from a global range sort, so the result is cut from its lineage:
    they must not be drawn twice. ``start`` lies above every number given before.
    """
    number = F.monotonically_increasing_id() + F.lit(start)
    return cut(records.orderBy(*order).withColumn(name, number))


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Size of the largest group; one number reaches the driver."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    name: str,
    group_rows: int = ORDERED_GROUP_ROWS,
) -> DataFrame:
    """Sum of ``value`` over the rows of a group up to and including the current one.

    ``order`` must be total within a group. Groups beyond ``group_rows`` are split by a range
    partitioning on key and order; each slice adds the totals of the slices before it, and a
    group has at most one slice per partition.
    """
    within = Window.partitionBy(*keys).orderBy(*order)
    if largest_group(df, keys) <= group_rows:
        rows = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(name, F.sum(value).over(rows))
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = cut(
        df.withColumn("_value", value)
        .repartitionByRange(pieces, *keys, *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.sum("_value").alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    inside = (
        Window.partitionBy("_slice", *keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        sliced.withColumn("_local", F.sum("_value").over(inside))
        .join(offsets, [*keys, "_slice"])
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_value", "_slice", "_local", "_offset")
    )
