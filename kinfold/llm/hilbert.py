"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised into 2^bits cells of about equally many rows, from exact counts of its
values. A row's cells are a point of a grid; the Hilbert curve orders the points so that neighbours
on the curve are neighbours in the grid. Rows sorted by curve index are cut into runs, one per
shard, whose sizes differ by at most one row. A run covers a compact part of the grid, so a filter
on any of the dimensions rules out most shards by their least and greatest values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinfold.llm.ranks import ranked
from kinfold.operators.order import running_total

BITS = 4
DIMENSIONS = ("source", "lang", "n_chars")
SHARDS = 24


def bounds(rows: DataFrame, dimension: str, bits: int = BITS) -> list[tuple[int, object]]:
    """(cell, least value) of every cell that holds a value: at most 2^bits pairs.

    A value's cell is the share of rows with a smaller value, in units of 2^-bits; nulls are
    smaller than all values. Only counts by value are ordered, however many rows one value has.
    """
    counts = rows.groupBy(F.col(dimension).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = running_total(counts, [], [F.col("v").asc_nulls_first()], F.col("n"), "upto")
    total = counts.agg(F.sum("n")).first()[0]
    cell = F.floor((F.col("upto") - F.col("n")) * F.lit(2**bits) / F.lit(total)).cast("int")
    found = upto.filter("v is not null").groupBy(cell.alias("cell")).agg(F.min("v").alias("least"))
    return [(r.cell, r.least) for r in found.orderBy("cell").collect()]


def cell_of(value: Column, found: list[tuple[int, object]]) -> Column:
    """Cell of a value under ``bounds``; null, and what lies below every bound, is in cell 0."""
    cell = F.lit(0)
    for number, least in found:
        cell = F.when(value >= F.lit(least), F.lit(number)).otherwise(cell)
    return cell


def with_curve(points: DataFrame, axes: list[str], bits: int, name: str) -> DataFrame:
    """Replace the coordinates ``axes`` (0 to 2^bits - 1) by the index of their point on the curve.

    Skilling's transform (2004): undo the turns of each level from the coarsest on, take the Gray
    code of what is left, and interleave the bits. Every step is one projection.
    """
    first, last = axes[0], axes[-1]
    for level in range(bits - 1, 0, -1):
        low = F.lit((1 << level) - 1)
        for axis in axes:
            turned = F.col(axis).bitwiseAND(F.lit(1 << level)) != 0
            differ = F.col(first).bitwiseXOR(F.col(axis)).bitwiseAND(low)
            step = {first: F.when(turned, F.col(first).bitwiseXOR(low)).otherwise(F.col(first).bitwiseXOR(differ))}
            if axis != first:
                step[axis] = F.when(turned, F.col(axis)).otherwise(F.col(axis).bitwiseXOR(differ))
            points = points.withColumns(step)
    for before, axis in zip(axes, axes[1:]):
        points = points.withColumn(axis, F.col(axis).bitwiseXOR(F.col(before)))
    flips = F.lit(0)
    for level in range(bits - 1, 0, -1):
        on = F.col(last).bitwiseAND(F.lit(1 << level)) != 0
        flips = flips.bitwiseXOR(F.when(on, F.lit((1 << level) - 1)).otherwise(F.lit(0)))
    points = points.withColumn(name, flips)
    index = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            bit = F.shiftright(F.col(axis).bitwiseXOR(F.col(name)), level).bitwiseAND(F.lit(1))
            index = index * 2 + bit
    return points.withColumn(name, index).drop(*axes)


def shard(
    docs: DataFrame,
    dimensions: tuple[str, ...] = DIMENSIONS,
    shards: int = SHARDS,
    bits: int = BITS,
    ties: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """(row, curve, shard, slot): every input row as the struct ``row``, with its place.

    Rows are ordered by curve index, then by ``ties`` and the dimensions; shard k takes the rows
    from k/shards to (k+1)/shards of all, so two shards differ by at most one row, and slots run
    from 0 without gaps. Null dimensions lie in cell 0, null ties come first, rows alike in all of
    these are interchangeable. Input columns of any name are safe inside ``row``. An empty table
    gives no rows; with fewer rows than shards some shards stay empty.
    """
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        *(F.col(d).alias(f"d{i}") for i, d in enumerate(dimensions)),
        *(F.col(t).alias(f"t{i}") for i, t in enumerate(ties)),
    )
    axes = [f"x{i}" for i in range(len(dimensions))]
    cells = {x: cell_of(F.col(f"d{i}"), bounds(rows, f"d{i}", bits)) for i, x in enumerate(axes)}
    placed = with_curve(rows.withColumns(cells), axes, bits, "curve")
    order = ["curve", *(f"t{i}" for i in range(len(ties))), *(f"d{i}" for i in range(len(dimensions)))]
    placed = ranked(placed.select("row", *order), [], [F.col(c).asc_nulls_first() for c in order])
    number = F.floor(F.col("rank") * shards / F.col("total"))
    first = F.ceil(number * F.col("total") / F.lit(shards))
    return placed.select(
        "row", "curve", number.cast("int").alias("shard"), (F.col("rank") - first).cast("long").alias("slot")
    )


def write_shards(sharded: DataFrame, folder: str, dimensions: tuple[str, ...] = DIMENSIONS) -> None:
    """Write the rows of ``shard`` as Parquet by shard, and each shard's ranges beside them.

    ``folder``/data holds the shards with their rows in order, ``folder``/ranges one row per shard:
    its rows, and least, greatest and nulls of every dimension.
    """
    spark = sharded.sparkSession
    spark_rows = sharded.sortWithinPartitions("shard", "slot")
    spark_rows.write.partitionBy("shard").parquet(f"{folder}/data")
    written = spark.read.parquet(f"{folder}/data")
    measures = []
    for i, d in enumerate(dimensions):
        value = F.col("row")[d]
        measures += [
            F.min(value).alias(f"least{i}"), F.max(value).alias(f"greatest{i}"),
            F.count_if(value.isNull()).alias(f"nulls{i}"),
        ]
    written.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *measures).write.parquet(f"{folder}/ranges")


def read_shards(
    spark: SparkSession,
    folder: str,
    within: dict[str, tuple[object, object]],
    dimensions: tuple[str, ...] = DIMENSIONS,
) -> DataFrame:
    """Rows whose dimensions lie ``within`` the given closed ranges, from the shards that can hold any.

    Nulls are in no range. Only as many numbers as there are shards reach the driver.
    """
    ranges = spark.read.parquet(f"{folder}/ranges")
    data = spark.read.parquet(f"{folder}/data")
    for d, (low, high) in within.items():
        i = dimensions.index(d)
        ranges = ranges.filter((F.col(f"greatest{i}") >= F.lit(low)) & (F.col(f"least{i}") <= F.lit(high)))
        data = data.filter(F.col("row")[d].between(F.lit(low), F.lit(high)))
    asked = [r.shard for r in ranges.select("shard").collect()]
    return data.filter(F.col("shard").isin(asked) if asked else F.lit(False))
