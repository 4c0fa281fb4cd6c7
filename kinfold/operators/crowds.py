"""How many guests a detached record may be, through identifiers that too many records share.

A record that comes back is a doubtful match for every guest that holds one of its crowded
identifiers, so the pairs grow with the square of the crowd. Here they are only counted: a guest
holds an identifier always, from the return of a record on, or until one is taken out, and the
number of holders at a moment is a running total over these moments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinfold.operators.identity import IDENTIFIER
from kinfold.operators.order import ORDERED_GROUP_ROWS, running_total
from kinfold.session import cut

PRESENT = "always or since < turn or turn < until"


def holders_in_time(carriers: DataFrame, links: DataFrame, detached: DataFrame, emptied: DataFrame) -> DataFrame:
    """(identifier, guest_no, always, since, until): when a guest of ``links`` holds it, for turns.

    ``detached`` (record_no, turn, at, guest_no) are records taken out of a guest by decision ``at``
    and back, in their guest of ``links``, after ``turn``. A guest with both a ``since`` and an
    ``until`` lacks the identifier in between.
    """
    out = detached.select("record_no", "turn", "at", F.col("guest_no").alias("left_guest"))
    placed = carriers.select(*IDENTIFIER, "record_no").distinct().join(
        links.select("record_no", "guest_no"), "record_no"
    ).join(out, "record_no", "left")
    back = F.struct("guest_no", F.col("turn").isNull().alias("always"), F.col("turn").alias("since"), F.lit(None).cast("long").alias("until"))
    gone = F.struct(
        F.col("left_guest").alias("guest_no"), F.lit(False).alias("always"), F.lit(None).cast("long").alias("since"),
        F.col("at").alias("until"),
    )
    spans = F.when(F.col("turn").isNull(), F.array(back)).otherwise(F.array(back, gone))
    held = placed.select(*IDENTIFIER, F.inline(spans)).groupBy(*IDENTIFIER, "guest_no").agg(
        F.max("always").alias("always"), F.min("since").alias("since"), F.max("until").alias("until")
    )
    always = F.col("always") | F.coalesce(F.col("since") < F.col("until"), F.lit(False))
    return held.join(emptied.select("tenant_id", "guest_no"), ["tenant_id", "guest_no"], "left_anti").select(
        *IDENTIFIER, "guest_no", always.alias("always"),
        F.when(~always, F.col("since")).alias("since"), F.when(~always, F.col("until")).alias("until"),
    )


def count_candidates(
    looks: DataFrame, held: DataFrame, known: DataFrame, group_rows: int = ORDERED_GROUP_ROWS
) -> DataFrame:
    """(tenant_id, record_no, turn, candidates) with at least one, per record of ``looks``.

    ``looks`` (identifier, record_no, turn) are the crowded identifiers of the records that come
    back, ``held`` is ``holders_in_time``, and ``known`` (record_no, guest_no) are guests that do not
    count. A guest that shares several identifiers with a record counts once: only guests of the
    record's smaller crowds are looked at one by one.
    """
    when = [*IDENTIFIER, "moment", "part"]
    ends = F.array(
        F.struct(F.lit(-(2**63)).cast("long").alias("moment"), F.lit(0).alias("part"), (F.col("always") | F.col("until").isNotNull()).cast("long").alias("change")),
        F.struct(F.col("until").alias("moment"), F.lit(0).alias("part"), F.lit(-1).cast("long").alias("change")),
        F.struct(F.col("since").alias("moment"), F.lit(2).alias("part"), F.lit(1).cast("long").alias("change")),
    )
    changes = held.select(*IDENTIFIER, F.inline(ends)).filter("moment is not null and change <> 0")
    asked = looks.select(*IDENTIFIER, F.col("turn").alias("moment"), F.lit(1).alias("part"), F.lit(0).cast("long").alias("change"))
    moments = cut(changes.unionByName(asked).groupBy(*when).agg(F.sum("change").alias("change")))
    totals = running_total(moments, IDENTIFIER, ["moment", "part"], F.col("change"), "holders", group_rows)
    seen = cut(
        looks.join(totals.filter("part = 1").select(*IDENTIFIER, F.col("moment").alias("turn"), "holders"), [*IDENTIFIER, "turn"])
    )
    record = ["tenant_id", "record_no", "turn"]
    sizes = seen.groupBy(*record).agg(
        F.sum("holders").alias("all_holders"), F.count(F.lit(1)).alias("crowds"),
        F.max(F.struct("holders", "type", "value")).alias("largest"),
    )
    # Guests met twice: through every crowd of a record but its largest, then in all its crowds.
    several = sizes.filter("crowds > 1").select(*record, "largest")
    smaller = looks.join(several, record).filter("type <> largest.type or value <> largest.value").drop("largest")
    one_by_one = smaller.join(held, IDENTIFIER).filter(PRESENT).select(*record, "guest_no").distinct()
    one_by_one = one_by_one.unionByName(
        known.join(looks.select(*record).distinct(), "record_no").select(*record, "guest_no")
    ).distinct()
    ignored = known.select("record_no", "guest_no").distinct().withColumn("ignored", F.lit(True))
    met = (
        one_by_one.join(looks, record).join(held, [*IDENTIFIER, "guest_no"]).filter(PRESENT)
        .groupBy(*record, "guest_no").agg(F.count(F.lit(1)).alias("times"))
        .join(ignored, ["record_no", "guest_no"], "left")
        .groupBy(*record).agg(F.sum(F.col("times") - F.when(F.col("ignored"), 0).otherwise(1)).alias("surplus"))
    )
    return (
        sizes.join(met, record, "left")
        .select(*record, (F.col("all_holders") - F.coalesce("surplus", F.lit(0))).alias("candidates"))
        .filter("candidates > 0")
    )
