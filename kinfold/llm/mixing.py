"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a share of all words (``source_targets``) and a weight curve over training time.
The integral of the curve, scaled to the target, is the source's cumulative demand. A source's
documents stand in a fixed pseudo-random order, repeated as often as needed; a document's place in
that order is inverted through the demand to a training position in [0, 1], and the mix is
range-sorted by position.

No source is ever ordered in one task: the order is by a hash of the id, its first digits cut every
source into slices, slice totals give each slice its offset, and only rows of one slice are sorted
together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.operators.order import running_total
from kinfold.session import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
# Weight curves by equally spaced knots, linear in between, given to the sources in turn as the
# weights are: steady, rising, falling. Only the shape counts; the area is the source's target.
CURVES = ((1.0, 1.0, 1.0), (0.5, 1.0, 1.5), (1.5, 1.0, 0.5))
# Leading hexadecimal digits of the order key: 4096 slices a source.
SLICE_DIGITS = 3


def word_count(text: str = "text") -> Column:
    """Words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS
) -> DataFrame:
    """(source, source_size, turn, weight, target) from one row (source, source_size) per source.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes by
    weight. No target exceeds ``most`` times its source's size; the excess is shared again by
    weight. With sources sorted by bound over weight, the level after the first k are full is
    (all - their bounds) / (the other weights); the final level is the largest of these.
    """
    turned = running_total(sizes, [], [F.col("source").asc_nulls_last()], F.lit(1), "_n")
    turn = F.pmod(F.col("_n") - 1, F.lit(len(weights)))
    weighted = turned.select(
        "source", "source_size", turn.alias("turn"),
        F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long").alias("weight"),
        (F.lit(most) * F.col("source_size")).alias("_bound"), "_n",
    )
    ordered = weighted.withColumn("_ratio", F.col("_bound") / F.col("weight"))
    ordered = running_total(ordered, [], ["_ratio", "_n"], F.col("_bound"), "_full")
    ordered = cut(running_total(ordered, [], ["_ratio", "_n"], F.col("weight"), "_used"))
    size, weight = ordered.agg(F.sum("source_size"), F.sum("weight")).first()
    if size is None:
        return ordered.withColumn("target", F.lit(0.0)).drop("_bound", "_n", "_ratio", "_full", "_used")
    level = (F.lit(size) - (F.col("_full") - F.col("_bound"))) / (
        F.lit(weight) - (F.col("_used") - F.col("weight"))
    )
    level = ordered.agg(F.max(level)).first()[0]
    target = F.least(F.col("_bound").cast("double"), F.lit(level) * F.col("weight"))
    return ordered.select("source", "source_size", "turn", "weight", target.alias("target"))


def position(share: Column, turn: Column, curves: tuple[tuple[float, ...], ...] = CURVES) -> Column:
    """Training time at which a curve has used up ``share`` (0 to 1) of its area.

    Within a span the weight is linear, so demand is quadratic and its inverse is closed.
    """
    found = F.lit(None).cast("double")
    for index, curve in enumerate(curves):
        width = 1.0 / (len(curve) - 1)
        spans = list(zip(curve, curve[1:], strict=False))
        area = sum((a + b) / 2 * width for a, b in spans)
        done, at = 0.0, F.lit(1.0)
        pieces = []
        for k, (a, b) in enumerate(spans):
            step = (a + b) / 2 * width
            left = share * area - done
            under = F.greatest(F.lit(0.0), F.lit(a * a) + 2 * (b - a) / width * left)
            inside = 2 * left / (F.lit(a) + F.sqrt(under))
            pieces.append((done + step, F.lit(k * width) + F.coalesce(inside, F.lit(0.0))))
            done += step
        for upto, value in reversed(pieces):
            at = F.when(share * area <= upto, value).otherwise(at)
        found = F.when(turn == index, F.least(at, F.lit(1.0))).otherwise(found)
    return found


def assign(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    size: Column | None = None,
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_REPEATS,
) -> DataFrame:
    """``docs`` with _size, _source_size, _target, _turn, _copies and _place.

    ``_place`` is where the document's first copy is centred among its source's words. A copy is
    taken if its centre lies before the target, so what a source gives is within one document of
    it, and no document is taken more than ``most`` times. ``docs`` has no columns of these names
    nor _source, _key, _slice, _group, _offset, _g, _t (``mix`` takes any). Null sources are one source; sizes of
    null or empty texts are 0; a source without words gives nothing. Rows that repeat are ordered
    as documents of their own. The order depends on ids and texts alone, so reruns agree.
    """
    size = word_count(text) if size is None else size
    key = F.coalesce(F.md5(F.col(doc_id).cast("string")), F.lit(""))
    rows = docs.withColumns(
        {"_size": size, "_key": key, "_source": F.col(source).cast("string")}
    ).withColumn("_slice", F.substring("_key", 1, SLICE_DIGITS))
    # One name without nulls for the join and the window, so that whole rows are shuffled once for both.
    group = F.concat("_slice", F.lit(":"), F.coalesce(F.concat(F.lit("="), "_source"), F.lit("")))
    slices = cut(rows.groupBy("_source", "_slice").agg(F.sum("_size").alias("_sum")))
    totals = slices.groupBy(F.col("_source").alias("source")).agg(F.sum("_sum").alias("source_size"))
    targets = source_targets(totals, weights, most).select(
        F.col("source").alias("_t"), F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"), F.col("turn").alias("_turn"),
    )
    before = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slices.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .join(targets, F.col("_source").eqNullSafe(F.col("_t")))
        .select(
            group.alias("_g"), "_offset", "_source_size", "_target", "_turn",
        )
    )
    rows = rows.withColumn("_group", group)
    joined = rows.join(offsets, F.col("_group") == F.col("_g"))
    content = [F.xxhash64(F.col(text))] if text in docs.columns else []
    inside = (
        Window.partitionBy("_group")
        .orderBy("_key", doc_id, "_size", *content)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    place = F.col("_offset") + F.sum("_size").over(inside) - F.col("_size") / F.lit(2.0)
    copies = F.ceil((F.col("_target") - F.col("_place")) / F.col("_source_size"))
    return (
        joined.withColumn("_place", place)
        .withColumn("_copies", F.when(F.col("_source_size") > 0, F.greatest(copies, F.lit(0))).otherwise(0))
        .withColumn("_copies", F.col("_copies").cast("int"))
        .drop("_g", "_group", "_offset", "_key", "_slice", "_source")
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_REPEATS,
    curves: tuple[tuple[float, ...], ...] = CURVES,
    name: str = "position",
) -> DataFrame:
    """The mix itself: every taken copy of every document, range-sorted by training position.

    A column of the name ``name`` is replaced, all others are carried along whatever their names.
    Documents without words have a size of 0: they go with a copy where their place lies before
    the target. Null sources are one source; rows that repeat are documents of their own; an
    empty table gives an empty one.
    """
    inner = {doc_id: "doc_id", source: "source", text: "text"}
    inner |= {c: f"extra{n}" for n, c in enumerate(docs.columns) if c not in inner}
    own = docs.select(*(F.col(c).alias(inner[c]) for c in docs.columns))
    taken = assign(own, weights=weights, most=most)
    kept = [c for c in docs.columns if c != name]
    placed = place(taken, [inner[c] for c in {doc_id: None, **dict.fromkeys(kept)}], "doc_id", curves)
    return placed.select(*(F.col(inner[c]).alias(c) for c in kept), F.col("position").alias(name))


def place(
    assigned: DataFrame,
    kept: list[str],
    doc_id: str = "doc_id",
    curves: tuple[tuple[float, ...], ...] = CURVES,
    name: str = "position",
) -> DataFrame:
    """Columns ``kept`` and the position of every copy that ``assign`` takes, range-sorted by position."""
    copies = assigned.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    share = (F.col("_place") + F.col("_copy") * F.col("_source_size")) / F.col("_target")
    turn = F.pmod(F.col("_turn"), F.lit(len(curves)))
    placed = copies.withColumn(name, position(F.least(share, F.lit(1.0)), turn, curves))
    pieces = int(assigned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.select(*kept, name).repartitionByRange(pieces, name).sortWithinPartitions(name, doc_id)
