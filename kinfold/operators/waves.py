"""Which steward decisions may be taken together.

A decision touches guests: the one it names, those of the records and reviews it names, and, for
an unmerge, every guest that carries a matching identifier of the records it takes out, because
these may join it. Two decisions that touch nothing in common give the same result in either order,
and nothing that an earlier one does can make it touch more than it and the decisions between touch
already. So a decision is ready once no earlier one waits at anything it touches.

Two decisions on one review share its guests. Only the earliest at each guest, identifier and rule
counts, so a guest with a thousand decisions is a row, and no two decisions are ever paired.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinfold import schemas as V
from kinfold.operators.identity import IDENTIFIER
from kinfold.operators.separations import named_pairs
from kinfold.session import cut

DECISION = ["tenant_id", "decision_id"]


def _named_records(waiting: DataFrame) -> DataFrame:
    unmerges = waiting.filter("kind = 'UNMERGE'")
    return unmerges.select(
        *DECISION, "at", F.posexplode(F.array_distinct(F.array_compact("record_nos"))).alias("place", "record_no")
    )


def touched_guests(world, waiting: DataFrame) -> DataFrame:
    """(tenant_id, decision_id, at, guest_no): the guests that each decision touches.

    Reviews and rules that are not there yet are read from their names, which tell records and
    guest, and an unmerge touches the guests that its records may found: so a decision also waits
    for the one that makes what it names.
    """
    links = world.links.select("tenant_id", "record_no", "guest_no")
    named = _named_records(waiting)
    form = r"^(-?[0-9]{1,18}):(-?[0-9]{1,18})(:[0-9]+)?$"
    told = [F.regexp_extract("review_id", form, k) for k in (1, 2)]
    reviews = world.reviews.select("tenant_id", "review_id", "record_no", "candidate")
    judged = waiting.filter("kind in ('CONFIRM', 'REJECT')").select(*DECISION, "at", "review_id").join(
        reviews, ["tenant_id", "review_id"], "left"
    )
    judged = cut(
        judged.select(
            *DECISION, "at",
            F.coalesce("record_no", F.when(told[0] != "", told[0]).cast("long")).alias("record_no"),
            F.coalesce("candidate", F.when(told[1] != "", told[1]).cast("long")).alias("guest_no"),
        )
    )
    lifted = named_pairs(waiting.filter("kind = 'LIFT_RULE'").select(*DECISION, "at", "rule_id"))
    records = named.select(*DECISION, "at", "record_no").unionByName(judged.select(*DECISION, "at", "record_no"))
    for end in ("record_a", "record_b"):
        records = records.unionByName(lifted.select(*DECISION, "at", F.col(end).alias("record_no")))
    return (
        records.join(links, ["tenant_id", "record_no"]).select(*DECISION, "at", "guest_no")
        .unionByName(waiting.filter("kind = 'UNMERGE'").select(*DECISION, "at", "guest_no"))
        .unionByName(named.select(*DECISION, "at", (F.col("at") + F.col("place")).alias("guest_no")))
        .unionByName(judged.select(*DECISION, "at", "guest_no"))
        .filter("guest_no is not null").distinct()
    )


def ready(world, waiting: DataFrame) -> DataFrame:
    """Rows of ``waiting`` (decisions with their order ``at``) that no earlier waiting one can affect.

    Among them is always the earliest of each tenant.
    """
    touches = cut(touched_guests(world, waiting))
    links = world.links.select("tenant_id", "record_no", "guest_no")
    guest = ["tenant_id", "guest_no"]
    first = cut(touches.groupBy(*guest).agg(F.min("at").alias("first")))
    waits = [touches.join(first, guest).filter("first < at")]
    if waiting.filter("kind = 'UNMERGE'").head(1):
        waits += _same_identifier(world, waiting, touches, first, links)
    if world.rules.filter("lifted_at is null").head(1):
        waits.append(_same_rule(world, waiting, touches, links))
    blocked = waits[0].select(*DECISION)
    for part in waits[1:]:
        blocked = blocked.unionByName(part.select(*DECISION))
    return waiting.join(blocked.distinct(), DECISION, "left_anti")


def _same_identifier(world, waiting: DataFrame, touches: DataFrame, first: DataFrame, links: DataFrame) -> list[DataFrame]:
    """Decisions that wait for an earlier one at an identifier: of the records that unmerges take out, and of
    the guests touched."""
    guest = ["tenant_id", "guest_no"]
    ids = world.identifiers.select(*IDENTIFIER, "record_no")
    taken = _named_records(waiting).join(ids, ["tenant_id", "record_no"])
    asked = taken.groupBy(*IDENTIFIER).agg(F.min("at").alias("taken"))
    # One that more records share than may match brings nobody together: it opens reviews only, and
    # these are told apart by the order of decisions.
    sharing = ids.join(asked, IDENTIFIER, "left_semi").groupBy(*IDENTIFIER).agg(F.count_distinct("record_no").alias("sharing"))
    limit = F.coalesce("review_threshold", F.lit(V.DEFAULT_REVIEW_THRESHOLD))
    matching = sharing.join(world.thresholds, "tenant_id", "left").filter(F.col("sharing") <= limit)
    asked = cut(asked.join(matching.select(*IDENTIFIER), IDENTIFIER, "left_semi"))
    carried = cut(
        ids.join(asked, IDENTIFIER).join(links, ["tenant_id", "record_no"])
        .groupBy(*IDENTIFIER, "guest_no").agg(F.min("taken").alias("taken"))
    )
    at_guest = carried.groupBy(*guest).agg(F.min("taken").alias("taken"))
    at_identifier = carried.join(first, guest).groupBy(*IDENTIFIER).agg(F.min("first").alias("touched"))
    return [
        touches.join(at_guest, guest).filter("taken < at"),
        taken.join(asked.withColumnRenamed("taken", "earliest"), IDENTIFIER).filter("earliest < at"),
        taken.join(at_identifier, IDENTIFIER).filter("touched < at"),
    ]


def _same_rule(world, waiting: DataFrame, touches: DataFrame, links: DataFrame) -> DataFrame:
    """Lifting decisions that wait for an earlier one at a rule: a rule is cut by one at a time."""
    lifting = touches.join(waiting.filter("kind in ('CONFIRM', 'LIFT_RULE')").select(*DECISION), DECISION, "left_semi")
    guest = ["tenant_id", "guest_no"]
    first = lifting.groupBy(*guest).agg(F.min("at").alias("first"))
    active = world.rules.filter("lifted_at is null").select("tenant_id", "set_id")
    placed = world.sides.join(active, ["tenant_id", "set_id"], "left_semi").join(links, ["tenant_id", "record_no"])
    placed = cut(placed.join(first, guest).select("tenant_id", "set_id", "guest_no", "first").distinct())
    of_rule = placed.groupBy("tenant_id", "set_id").agg(F.min("first").alias("first"))
    of_guest = placed.select("tenant_id", "set_id", "guest_no").join(of_rule, ["tenant_id", "set_id"])
    of_guest = of_guest.groupBy(*guest).agg(F.min("first").alias("first"))
    return lifting.join(of_guest, guest).filter("first < at")
