"""Ranks within groups of any size, without ordering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.session import cut


def ranked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``rank`` (from 0, within the key), ``total`` (rows of the key) and ``first``.

    ``first`` is the rank of the key's first row among all rows, an id of the key that rises with
    it; null keys come first. One range sort deals the rows out by key and order, so a key with a
    third of all rows lies in as many slices as it fills; a slice needs only its own rows and the
    counts of the slices before it. Rows alike in key and order may lie in several slices and get
    their ranks in any order. ``df`` is read twice (once for the sort's bounds) and its columns
    must not be called rank, total, first or begin with an underscore.
    """
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*(F.col(k).asc_nulls_first() for k in keys), *order, F.col("_tie")]
    sliced = cut(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(pieces, *by)
        .sortWithinPartitions(*by)
        .drop("_tie")
        .withColumns({"_slice": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    )
    runs = sliced.groupBy("_slice", *keys).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_rows"))
    # One row a slice: the only window over all of them.
    slices = runs.groupBy("_slice").agg(F.min("_from").alias("_base"), F.sum("_rows").alias("_all"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("_slice", "_base", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.join(slices, "_slice").select(
        F.col("_slice").alias("_s"), *(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), "_from",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_done"),
        F.sum("_rows").over(whole).alias("total"),
        F.min(F.col("_before") + F.col("_from") - F.col("_base")).over(whole).alias("first"),
    )
    same = F.col("_slice") == F.col("_s")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return sliced.join(runs, same).select(
        *df.columns, (F.col("_done") + F.col("_at") - F.col("_from")).alias("rank"), "total", "first"
    )
