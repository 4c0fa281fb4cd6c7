"""Steward decisions over all guests of the order feed, as registered queries.

Guests are named by the order of their earliest record, records by their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kinfold.operators.decisions import REVIEW_SCHEMA, World, apply_decisions
from kinfold.operators.separations import RULE_SCHEMA, SIDE_SCHEMA, rule_pairs
from kinfold.session import cut
from kinfold.sources.extract import identifier_rows

# What decisions read of a person, beside its identifiers.
NAME_COLUMNS = ["first_fold", "last_fold", "effective_at", "received_at"]
START = "timestamp '2026-01-01 00:00:00'"
DECISION_COLUMNS = {
    "tenant_id": "string", "decision_id": "string", "kind": "string", "guest_no": "long",
    "record_nos": "array<bigint>", "review_id": "string", "rule_id": "string", "actor_type": "string",
    "actor_id": "string", "claimed_type": "string", "decided_at": "timestamp",
}


def decisions_of(rows: DataFrame) -> DataFrame:
    """Fill up ``rows`` to the columns of decisions; a person called sam decides."""
    given = {"actor_type": F.lit("HUMAN"), "actor_id": F.lit("sam")}
    return rows.select(
        *(
            (F.col(c) if c in rows.columns else given.get(c, F.lit(None))).cast(t).alias(c)
            for c, t in DECISION_COLUMNS.items()
        )
    )


def world_of_links(records: DataFrame, links: DataFrame, reviews: DataFrame | None = None) -> World:
    """Linked records without rules; the default threshold holds for all tenants."""
    spark = records.sparkSession
    identifiers = identifier_rows(records, "record_no").withColumn("gated", F.lit(False))
    empty = spark.createDataFrame([], REVIEW_SCHEMA)
    if reviews is not None:
        given = {"status": F.lit("PENDING"), "origin_type": F.lit("EMAIL"), "confidence": F.lit("1.000")}
        reviews = reviews.select(
            *(
                (F.col(f.name) if f.name in reviews.columns else given.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
                for f in empty.schema
            )
        )
    return World(
        records.select("tenant_id", *NAME_COLUMNS, "record_no"), cut(identifiers), links, spark.createDataFrame([], RULE_SCHEMA),
        spark.createDataFrame([], SIDE_SCHEMA), empty if reviews is None else cut(reviews),
        spark.createDataFrame([], "tenant_id string, review_threshold int"),
    )


def guests_of(links: DataFrame, records: DataFrame) -> DataFrame:
    """(tenant_id, guest_no, size, first_no, newest_no, first, newest): each guest's ends, by number and order."""
    sized = links.groupBy("tenant_id", "guest_no").agg(
        F.count(F.lit(1)).alias("size"), F.min("record_no").alias("first_no"), F.max("record_no").alias("newest_no")
    )
    for end in ("first", "newest"):
        sized = sized.join(records.select(F.col("record_no").alias(f"{end}_no"), F.col("ord").alias(end)), f"{end}_no")
    return sized


def unmerge_applied(spark: SparkSession, records: DataFrame, links: DataFrame) -> DataFrame:
    """The newest record of every guest is taken out: where it is now, from how many it is kept apart, and its reviews."""
    guests = cut(guests_of(links, records).filter("size > 1"))
    made = guests.select(
        "tenant_id", F.concat(F.lit("u"), F.col("newest").cast("string")).alias("decision_id"),
        F.lit("UNMERGE").alias("kind"), "guest_no", F.array("newest_no").alias("record_nos"),
        (F.expr(START) + F.make_dt_interval(secs=F.col("newest"))).alias("decided_at"),
    )
    after, events, _ = apply_decisions(world_of_links(records, links), decisions_of(made), as_cases=True)
    now = after.links.select(F.col("record_no").alias("newest_no"), F.col("guest_no").alias("own"))
    names = guests_of(after.links, records).select(F.col("guest_no").alias("own"), F.col("first").alias("now_in"), "size")
    apart = after.sides.filter("side = 'B'").groupBy(F.col("set_id").alias("decision_id")).agg(F.count(F.lit(1)).alias("kept_apart"))
    queued = after.reviews.select("record_no", F.lit(1).cast("long").alias("candidates"))
    if after.cases is not None:
        queued = queued.unionByName(after.cases.select("record_no", "candidates"))
    queued = queued.groupBy(F.col("record_no").alias("newest_no")).agg(F.sum("candidates").alias("reviews"))
    replay = events.filter("kind <> 'UNMERGE'").select(F.col("record_nos")[0].alias("newest_no"), F.col("kind").alias("replayed"))
    return (
        guests.withColumn("decision_id", F.concat(F.lit("u"), F.col("newest").cast("string"))).drop("size")
        .join(now, "newest_no").join(names, "own").join(replay, "newest_no")
        .join(apart, "decision_id", "left").join(queued, "newest_no", "left")
        .select(
            "tenant_id", F.col("newest").alias("ord"), F.col("first").alias("left_guest"), "now_in",
            F.col("size").alias("now_size"), "replayed", F.coalesce("kept_apart", F.lit(0)).alias("kept_apart"),
            F.coalesce("reviews", F.lit(0)).alias("reviews"),
        )
    )


def _in_order(guests: DataFrame, width: int) -> DataFrame:
    """Add ``grp`` and ``place``: guests of a tenant dealt out by their first order, ``width`` to a group.

    The first order's last digits stand for its rank: a group is a block of the order numbers with
    up to ``width`` guests, so no tenant is ever ordered in one task.
    """
    block = F.floor(F.col("first") / F.lit(64))
    dealt = Window.partitionBy("tenant_id", block).orderBy("first")
    place = F.row_number().over(dealt) - 1
    return guests.withColumn("n_", place).select(
        *guests.columns, F.concat_ws("-", "tenant_id", block.cast("string"), F.floor(F.col("n_") / width).cast("string")).alias("grp"),
        (F.col("n_") % width).alias("place"),
    )


def _beside(guests: DataFrame, mine: int, other: int) -> DataFrame:
    """Guest at place ``mine`` of each group with the one at ``other`` as candidate."""
    b = guests.filter(F.col("place") == other).select(
        "grp", F.col("guest_no").alias("candidate"), F.col("first").alias("candidate_first"),
        F.col("first_no").alias("candidate_no"), F.col("size").alias("candidate_size"),
    )
    return guests.filter(F.col("place") == mine).join(b, "grp")


def _at(step: int):
    return F.expr(START) + F.make_dt_interval(days=F.lit(step))


def review_decisions_applied(spark: SparkSession, records: DataFrame, links: DataFrame) -> DataFrame:
    """Guests by threes: the first joins the second; the second is then joined to the third or kept
    apart from it, by the parity of its newest order; the first review is decided once more, too late."""
    guests = cut(_in_order(guests_of(links, records), 3))
    step = F.lit(1)
    reviews = None
    for mine in (0, 1):
        part = _beside(guests, mine, mine + 1).withColumn("step", F.lit(mine))
        reviews = part if reviews is None else reviews.unionByName(part)
    reviews = cut(
        reviews.select(
            "tenant_id", F.concat_ws(":", F.lit("r"), F.col("newest").cast("string")).alias("review_id"),
            F.col("newest_no").alias("record_no"), "newest", "candidate", "candidate_first", "candidate_size", "step",
        )
    )
    rejected = (F.col("step") == step) & (F.col("newest") % 2 == 0)
    first = reviews.select(
        "tenant_id", F.concat(F.lit("d"), "review_id").alias("decision_id"),
        F.when(rejected, "REJECT").otherwise("CONFIRM").alias("kind"), "review_id",
        (F.expr(START) + F.make_dt_interval(days=F.col("step"))).alias("decided_at"),
    )
    again = reviews.filter("step = 0").select(
        "tenant_id", F.concat(F.lit("e"), "review_id").alias("decision_id"), F.lit("REJECT").alias("kind"),
        "review_id", _at(2).alias("decided_at"),
    )
    after, events, errors = apply_decisions(
        world_of_links(records, links, reviews.select("tenant_id", "review_id", "record_no", "candidate")),
        decisions_of(first.unionByName(again)),
    )
    names = guests_of(after.links, records).select("guest_no", F.col("first").alias("now_in"), F.col("size").alias("now_size"))
    now = after.links.select("record_no", "guest_no").join(names, "guest_no").drop("guest_no")
    status = after.reviews.select("review_id", "status")
    apart = after.sides.filter("side = 'B'").groupBy(F.substring("set_id", 2, 100).alias("review_id")).agg(
        F.count(F.lit(1)).alias("kept_apart")
    )
    failed = errors.select(F.substring("decision_id", 2, 100).alias("review_id"), F.regexp_replace("error", "r:[0-9]+", "#").alias("error"))
    absorbed = events.select(F.substring("event_id", 2, 100).alias("review_id"), F.size("absorbed_guests").alias("absorbed"))
    return (
        reviews.join(now, "record_no").join(status, "review_id").join(absorbed, "review_id")
        .join(apart, "review_id", "left").join(failed, "review_id", "left")
        .select(
            "tenant_id", F.col("newest").alias("ord"), "candidate_first", "status", "now_in", "now_size", "absorbed",
            F.coalesce("kept_apart", F.lit(0)).alias("kept_apart"), "error",
        )
    )


def rule_lift(spark: SparkSession, records: DataFrame, links: DataFrame) -> DataFrame:
    """Guests by twos are kept apart; one pair of the rule is lifted, or all by a confirmation, or none."""
    guests = cut(_in_order(guests_of(links, records), 2))
    pairs = cut(_beside(guests, 0, 1).withColumn("turn", F.col("newest") % 3))
    name = F.col("newest").cast("string")
    reviews = pairs.select("tenant_id", F.concat(F.lit("a"), name).alias("review_id"), F.col("newest_no").alias("record_no"), "candidate")
    reviews = reviews.unionByName(
        pairs.filter("turn = 1").select("tenant_id", F.concat(F.lit("b"), name).alias("review_id"), F.col("newest_no").alias("record_no"), "candidate")
    )
    low, high = F.least("newest_no", "candidate_no"), F.greatest("newest_no", "candidate_no")
    rule_id = F.concat_ws(":", F.concat(F.lit("x"), name), low.cast("string"), high.cast("string"))
    made = pairs.select(
        "tenant_id", F.concat(F.lit("x"), name).alias("decision_id"), F.lit("REJECT").alias("kind"),
        F.concat(F.lit("a"), name).alias("review_id"), F.lit(None).cast("string").alias("rule_id"), _at(1).alias("decided_at"),
    ).unionByName(
        pairs.filter("turn < 2").select(
            "tenant_id", F.concat(F.lit("y"), name).alias("decision_id"),
            F.when(F.col("turn") == 0, "LIFT_RULE").otherwise("CONFIRM").alias("kind"),
            F.when(F.col("turn") == 1, F.concat(F.lit("b"), name)).alias("review_id"),
            F.when(F.col("turn") == 0, rule_id).alias("rule_id"), _at(2).alias("decided_at"),
        )
    )
    after, _, _ = apply_decisions(world_of_links(records, links, reviews), decisions_of(made))
    found = rule_pairs(after.rules, after.sides)
    for end in ("a", "b"):
        found = found.join(records.select(F.col("record_no").alias(f"record_{end}"), F.col("ord").alias(f"ord_{end}")), f"record_{end}")
    return found.select(
        "tenant_id", F.least("ord_a", "ord_b").alias("ord_a"), F.greatest("ord_a", "ord_b").alias("ord_b"), "origin",
        "actor_id", F.col("lifted_at").isNotNull().alias("lifted"), F.col("lifted_actor_id").alias("lifted_by"),
    )


def decision_errors(spark: SparkSession, records: DataFrame, links: DataFrame) -> DataFrame:
    """A decision on every guest that must be refused, with numbers in its message left out."""
    guests = guests_of(links, records)
    fault = F.col("first") % 7
    none = F.array().cast("array<bigint>")
    made = guests.select(
        "tenant_id", F.concat(F.lit("f"), F.col("first").cast("string")).alias("decision_id"),
        F.when(fault == 0, "SPLIT").when(fault <= 3, "UNMERGE").when(fault == 4, "CONFIRM").when(fault == 5, "LIFT_RULE")
        .otherwise("REJECT").alias("kind"),
        "guest_no", F.when(fault == 2, none).when(fault == 3, F.array(F.lit(-1).cast("long"))).otherwise(F.array("newest_no")).alias("record_nos"),
        F.lit("r0").alias("review_id"), F.lit("no such rule").alias("rule_id"),
        F.when(fault == 1, "SYSTEM").alias("claimed_type"), _at(0).alias("decided_at"),
    )
    _, _, errors = apply_decisions(world_of_links(records, links), decisions_of(made))
    return errors.select(
        "tenant_id", F.substring("decision_id", 2, 20).cast("long").alias("first"),
        F.regexp_replace("error", "-?[0-9]+", "#").alias("error"),
    )


DECISION_QUERIES = (unmerge_applied, review_decisions_applied, rule_lift, decision_errors)
