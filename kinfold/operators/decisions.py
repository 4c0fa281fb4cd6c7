"""Steward decisions applied to the current links, rules and reviews.

Decisions follow each other where they touch a guest, identifier, review or rule in common;
all others share a wave, which applies them with the same joins.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from kinfold import schemas as V
from kinfold.operators.crowds import count_candidates, holders_in_time
from kinfold.operators.identity import IDENTIFIER
from kinfold.operators.order import running_total
from kinfold.operators.reviews import follow_merges
from kinfold.operators.separations import in_force, lift, named_pairs, ruling, separate
from kinfold.operators.settle import settle
from kinfold.operators.waves import ready
from kinfold.session import cut

REVIEW_SCHEMA = (
    "tenant_id string, review_id string, record_no long, candidate long, origin_type string, "
    "origin_value string, reason string, matcher string, confidence decimal(4,3), "
    "status string, decided_at timestamp, decision_id string"
)
EVENT_SCHEMA = (
    "tenant_id string, event_id string, kind string, guest_no long, absorbed_guests array<bigint>, "
    "record_nos array<bigint>, matcher string, confidence decimal(4,3), "
    "excluded_guests array<bigint>, actor_type string, actor_id string, created_at timestamp"
)


@dataclass
class World:
    """Current state: records' people and identifiers, links, rules, reviews and settings.

    ``identifiers`` are the ones that may match (tenant_id, rank, type, value, record_no, gated);
    ``rules`` and ``sides`` are do-not-merge rules as two sets each (operators/separations.py);
    ``thresholds`` is (tenant_id, review_threshold). ``cases`` (tenant_id, record_no, turn, candidates),
    if kept, stand for that many PENDING reviews of crowded identifiers that ``reviews`` leaves out.
    """

    people: DataFrame
    identifiers: DataFrame
    links: DataFrame
    rules: DataFrame
    sides: DataFrame
    reviews: DataFrame
    thresholds: DataFrame
    cases: DataFrame | None = None


KINDS = ("UNMERGE", "CONFIRM", "REJECT", "LIFT_RULE")


def check_actor(decisions: DataFrame) -> DataFrame:
    """Refuse unknown kinds, and claims to another actor type than the credential's."""
    claim = F.upper(F.trim("claimed_type"))
    known = F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))
    return decisions.withColumn(
        "error",
        F.when(~known, F.concat(F.lit("No such kind of decision: "), F.coalesce("kind", F.lit("null")))).when(
            (claim != "") & (claim != F.upper("actor_type")),
            F.concat(
                F.lit("This credential acts as "), F.col("actor_type"),
                F.lit(" and cannot record a "), F.trim("claimed_type"), F.lit(" actor"),
            ),
        ),
    )


def check_unmerge(asked: DataFrame, links: DataFrame) -> DataFrame:
    """Add ``error`` to UNMERGE decisions that name no record, a lone guest or foreign records."""
    named = asked.select(
        "tenant_id", "decision_id", "guest_no",
        F.explode(F.array_distinct(F.array_compact("record_nos"))).alias("record_no"),
    )
    own = links.select("tenant_id", "record_no", F.col("guest_no").alias("own"))
    foreign = (
        named.join(own, ["tenant_id", "record_no"], "left")
        .filter("own is null or own <> guest_no")
        .groupBy("decision_id").agg(F.min("record_no").alias("foreign"))
    )
    sizes = (
        links.join(asked.select("tenant_id", "guest_no").distinct(), ["tenant_id", "guest_no"], "left_semi")
        .groupBy("tenant_id", "guest_no").agg(F.count(F.lit(1)).alias("size"))
    )
    return (
        asked.join(foreign, "decision_id", "left").join(sizes, ["tenant_id", "guest_no"], "left")
        .withColumn(
            "error",
            F.when(F.size(F.array_compact(F.coalesce("record_nos", F.array().cast("array<bigint>")))) == 0, "No source record ids given to detach")
            .when(
                F.coalesce("size", F.lit(0)) <= 1,
                F.concat(F.lit("Guest "), F.col("guest_no").cast("string"), F.lit(" has a single source record — nothing to split")),
            )
            .when(
                F.col("foreign").isNotNull(),
                F.concat(F.lit("Source record "), F.col("foreign").cast("string"), F.lit(" is not linked to guest "), F.col("guest_no").cast("string")),
            ),
        )
        .drop("foreign", "size")
    )


def _events(rows: DataFrame, kind: Column, guest: Column, absorbed: Column, records: Column,
            matcher: Column, excluded: Column, actor_type: Column, actor_id: Column) -> DataFrame:
    return rows.select(
        "tenant_id", F.col("event_id"), kind.alias("kind"), guest.alias("guest_no"),
        absorbed.cast("array<bigint>").alias("absorbed_guests"),
        records.cast("array<bigint>").alias("record_nos"), matcher.alias("matcher"),
        F.lit("1.000").cast("decimal(4,3)").alias("confidence"),
        excluded.cast("array<bigint>").alias("excluded_guests"),
        actor_type.alias("actor_type"), actor_id.alias("actor_id"),
        F.col("decided_at").alias("created_at"),
    )


def _unmerge(world: World, asked: DataFrame, as_cases: bool = False) -> tuple[World, DataFrame, DataFrame]:
    checked = cut(check_unmerge(asked, world.links))
    errors = checked.filter("error is not null").select("tenant_id", "decision_id", "error")
    good = checked.filter("error is null")
    detached = cut(
        good.select(
            "tenant_id", "decision_id", "guest_no", "actor_type", "actor_id", "decided_at", "at",
            F.posexplode(F.array_distinct(F.array_compact("record_nos"))).alias("place", "record_no"),
        ).withColumn("turn", F.col("at") + F.col("place"))
    )
    staying = world.links.join(detached.select("record_no"), "record_no", "left_anti")
    remaining = good.select("tenant_id", "decision_id", "guest_no").join(
        staying, ["tenant_id", "guest_no"]
    )
    made, apart = separate(detached, remaining, "UNMERGE")
    rules, sides = cut(world.rules.unionByName(made)), cut(world.sides.unionByName(apart))
    # Replay recounts sharing over all current records, not by arrival.
    mine = world.identifiers.join(detached.select("record_no", "turn", "at"), "record_no")
    asked_ids = mine.select(*IDENTIFIER).distinct()
    carriers = world.identifiers.join(asked_ids, IDENTIFIER, "left_semi")
    counts = carriers.groupBy(*IDENTIFIER).agg(F.count_distinct("record_no").alias("sharing"))
    judged = mine.join(counts, IDENTIFIER).join(world.thresholds, "tenant_id", "left").withColumn(
        "review_threshold", F.coalesce("review_threshold", F.lit(V.DEFAULT_REVIEW_THRESHOLD))
    )
    judged = cut(judged)
    theirs = detached.select(
        F.col("record_no").alias("earlier"), F.col("turn").alias("their_turn"), F.col("at").alias("their_at"),
        F.col("guest_no").alias("their_guest"),
    )
    other = carriers.select(*IDENTIFIER, F.col("record_no").alias("earlier")).join(theirs, "earlier", "left")
    # Records of the same decision that come back later are nowhere yet; those that a later decision
    # takes out are still where they were.
    met = judged.join(other, IDENTIFIER).filter(
        "earlier <> record_no and (their_turn is null or their_turn < turn or their_at > at)"
    )
    edges = met.filter("sharing <= review_threshold").select(
        "turn", "record_no", "rank", "type", "value", "gated", "earlier"
    )
    edges = cut(edges)
    touched = edges.select(F.col("earlier").alias("record_no")).distinct()
    guests = staying.join(touched, "record_no", "left_semi").select("guest_no").distinct()
    near = staying.join(guests, "guest_no", "left_semi")
    people = world.people.join(
        near.select("record_no").unionByName(detached.select("record_no")), "record_no", "left_semi"
    )
    excluded = detached.select("turn", "guest_no")
    outcomes, settled = settle(
        detached.select("tenant_id", "turn", "record_no"), edges, near, people, in_force(rules, sides), excluded
    )
    tenant_of = world.links.select("tenant_id", "record_no")
    links = cut(
        staying.join(settled.select("record_no"), "record_no", "left_anti")
        .select("tenant_id", "record_no", "guest_no")
        .unionByName(settled.join(tenant_of, "record_no").select("tenant_id", "record_no", "guest_no"))
    )
    emptied = good.select("tenant_id", "guest_no").distinct().join(
        links.select("tenant_id", "guest_no").distinct(), ["tenant_id", "guest_no"], "left_anti"
    )
    admitted = outcomes.filter("kind <> 'CREATE'").select("record_no", F.col("guest_no").alias("candidate"))
    crowded = (
        met.filter("sharing > review_threshold")
        .join(links.select(F.col("record_no").alias("earlier"), F.col("guest_no").alias("found")), "earlier")
        .withColumn("candidate", F.when(F.col("their_at") > F.col("at"), F.col("their_guest")).otherwise(F.col("found")))
        .join(emptied.select("tenant_id", F.col("guest_no").alias("candidate")), ["tenant_id", "candidate"], "left_anti")
        .join(detached.select("turn", F.col("guest_no").alias("left_guest")), "turn")
        .filter("candidate <> left_guest")
        .join(links.select("record_no", F.col("guest_no").alias("own")), "record_no").filter("candidate <> own")
        .select(
            "tenant_id", "record_no", "turn", "candidate", "rank", F.col("type").alias("origin_type"),
            F.col("value").alias("origin_value"),
            F.concat(
                F.lit("identifier shared by "), F.col("sharing").cast("string"),
                F.lit(" records (threshold "), F.col("review_threshold").cast("string"), F.lit(")"),
            ).alias("reason"),
        )
        .join(admitted, ["record_no", "candidate"], "left_anti")
    )
    vetoed = outcomes.select("tenant_id", "record_no", "turn", F.explode("vetoes").alias("v")).select(
        "tenant_id", "record_no", "turn", F.col("v.guest_no").alias("candidate"), F.lit(99).alias("rank"),
        F.col("v.type").alias("origin_type"), F.col("v.value").alias("origin_value"),
        F.col("v.reason").alias("reason"),
    )
    moved = outcomes.select("tenant_id", F.explode("absorbed_guests").alias("guest_no"), F.col("guest_no").alias("survivor"))
    reviews = follow_merges(world.reviews, moved, emptied)
    opened = vetoed if as_cases else crowded.unionByName(vetoed)
    reviews = cut(reviews.unionByName(_new_reviews(opened, reviews)))
    cases = world.cases
    if as_cases:
        looks = judged.filter("sharing > review_threshold").select(*IDENTIFIER, "record_no", "turn").distinct()
        crowd = carriers.join(looks.select(*IDENTIFIER).distinct(), IDENTIFIER, "left_semi")
        own = links.join(detached.select("record_no"), "record_no", "left_semi")
        pending = reviews.filter("status = 'PENDING'").select("record_no", F.col("candidate").alias("guest_no"))
        known = (
            own.select("record_no", "guest_no").unionByName(detached.select("record_no", "guest_no"))
            .unionByName(admitted.select("record_no", F.col("candidate").alias("guest_no"))).unionByName(pending)
        )
        held = cut(holders_in_time(crowd, links, detached, emptied))
        cases = cut(count_candidates(cut(looks), held, cut(known.distinct())))
    by_matcher = (
        F.when(F.col("kind") == "CREATE", V.CREATE_MATCHER).otherwise(V.DETERMINISTIC_MATCHER)
    )
    when = detached.select("turn", "decision_id", "decided_at")
    replayed = outcomes.join(when, "turn").withColumn(
        "event_id", F.concat_ws(":", "decision_id", F.lit("replay"), F.col("turn").cast("string"))
    )
    own = good.withColumn("event_id", F.col("decision_id"))
    none = F.array()
    events = _events(
        own, F.lit("UNMERGE"), F.col("guest_no"), none, F.array_distinct(F.array_compact("record_nos")),
        F.lit(V.UNMERGE_MATCHER), F.array("guest_no"), F.col("actor_type"), F.col("actor_id"),
    ).unionByName(
        _events(
            replayed, F.col("kind"), F.col("guest_no"), F.col("absorbed_guests"), F.array("record_no"),
            by_matcher, none, F.lit("SYSTEM"), by_matcher,
        )
    )
    return replace(world, links=links, rules=rules, sides=sides, reviews=reviews, cases=cases), events, errors


def _new_reviews(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Pairs that are not pending yet; the turn in the name tells them from decided ones of old."""
    one = rows.groupBy("tenant_id", "record_no", "candidate").agg(
        F.min_by(F.struct("origin_type", "origin_value", "reason", "turn"), "rank").alias("w")
    )
    open_pairs = existing.filter("status = 'PENDING'").select("tenant_id", "record_no", "candidate")
    return one.join(open_pairs, ["tenant_id", "record_no", "candidate"], "left_anti").select(
        "tenant_id",
        F.concat_ws(":", *(F.col(c).cast("string") for c in ("record_no", "candidate", "w.turn"))).alias("review_id"),
        "record_no", "candidate", "w.origin_type", "w.origin_value", "w.reason",
        F.lit(V.DETERMINISTIC_MATCHER).alias("matcher"),
        F.lit("1.000").cast("decimal(4,3)").alias("confidence"), F.lit("PENDING").alias("status"),
        F.lit(None).cast("timestamp").alias("decided_at"), F.lit(None).cast("string").alias("decision_id"),
    )


def _confirmed_lifts(confirmed: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A confirmation lifts every rule between the two guests, as they were before it; between the
    record alone and its guest's others if both are one guest already."""
    key = ["tenant_id", "lift_id"]
    named = confirmed.withColumn("lift_id", F.col("decision_id"))
    lifts = named.select(*key, F.col("decided_at").alias("at"), F.col("actor_type").alias("by_type"), F.col("actor_id").alias("by_id"))
    merging = F.col("record_guest") != F.col("candidate")
    m = named.filter(merging).select(*key, F.col("record_guest").alias("guest_no")).join(links, ["tenant_id", "guest_no"])
    m = m.select(*key, "record_no").unionByName(named.filter(~merging).select(*key, "record_no"))
    c = named.select(*key, F.col("candidate").alias("guest_no")).join(links, ["tenant_id", "guest_no"]).select(*key, "record_no")
    c = c.join(m, [*key, "record_no"], "left_anti")
    ends = m.withColumn("end", F.lit("M")).unionByName(c.withColumn("end", F.lit("C")))
    return lifts, cut(ends)


def _decide(world: World, asked: DataFrame) -> tuple[World, DataFrame, DataFrame]:
    """CONFIRM and REJECT: each review can be decided once."""
    reviews = world.reviews.select(
        "tenant_id", "review_id", "record_no", "candidate", F.col("status").alias("was")
    )
    asked = asked.drop("guest_no", "record_nos").join(reviews, ["tenant_id", "review_id"], "left").withColumn(
        "error",
        F.when(F.col("was").isNull(), F.concat(F.lit("No review "), F.col("review_id")))
        .when(F.col("was") != "PENDING", F.concat(F.lit("Review "), F.col("review_id"), F.lit(" is already "), F.col("was"))),
    )
    asked = cut(
        asked.join(
            world.links.select("record_no", F.col("guest_no").alias("record_guest")), "record_no", "left"
        )
    )
    errors = asked.filter("error is not null").select("tenant_id", "decision_id", "error")
    good = asked.filter("error is null")
    confirmed = good.filter("kind = 'CONFIRM'")
    rejected = good.filter("kind = 'REJECT'")
    merging = confirmed.filter("record_guest <> candidate")
    moved = merging.select("tenant_id", F.col("record_guest").alias("guest_no"), F.col("candidate").alias("survivor"))
    rules, sides = lift(world.rules, world.sides, *_confirmed_lifts(confirmed, world.links))
    apart = rejected.filter("record_guest <> candidate")
    candidate_side = apart.select("tenant_id", "decision_id", F.col("candidate").alias("guest_no")).join(
        world.links, ["tenant_id", "guest_no"]
    )
    made, both = separate(apart, candidate_side, "REVIEW_REJECT")
    rules, sides = cut(rules.unionByName(made)), cut(sides.unionByName(both))
    links = cut(
        world.links.join(moved, ["tenant_id", "guest_no"], "left").select(
            "tenant_id", "record_no", F.coalesce("survivor", "guest_no").alias("guest_no")
        )
    )
    verdict = good.select(
        "tenant_id", "review_id",
        F.when(F.col("kind") == "CONFIRM", "CONFIRMED").otherwise("REJECTED").alias("verdict"),
        F.col("decided_at").alias("at"), F.col("decision_id").alias("by"),
    )
    decided = world.reviews.join(verdict, ["tenant_id", "review_id"], "left").select(
        *[c for c in world.reviews.columns if c not in ("status", "decided_at", "decision_id")],
        F.coalesce("verdict", "status").alias("status"),
        F.coalesce("at", "decided_at").alias("decided_at"),
        F.coalesce("by", "decision_id").alias("decision_id"),
    )
    reviews_now = cut(follow_merges(decided, moved).select(*world.reviews.columns))
    none = F.array()
    absorbed = F.when(
        (F.col("kind") == "CONFIRM") & (F.col("record_guest") != F.col("candidate")), F.array("record_guest")
    ).otherwise(F.array().cast("array<bigint>"))
    events = _events(
        good.withColumn("event_id", F.col("decision_id")),
        F.when(F.col("kind") == "CONFIRM", "REVIEW_CONFIRM").otherwise("REVIEW_REJECT"),
        F.col("candidate"), absorbed, F.array("record_no"), F.lit(V.REVIEW_MATCHER), none,
        F.col("actor_type"), F.col("actor_id"),
    )
    return replace(world, links=links, rules=rules, sides=sides, reviews=reviews_now), events, errors


def _lift_rules(world: World, asked: DataFrame) -> tuple[World, DataFrame]:
    named = cut(ruling(named_pairs(asked), world.rules, world.sides))
    stands = F.coalesce(F.col("standing") == F.col("ruled_by"), F.lit(False))
    errors = named.filter(~stands).select(
        "tenant_id", "decision_id", F.concat(F.lit("No active rule "), F.coalesce("rule_id", F.lit("null"))).alias("error")
    )
    hits = named.filter(stands).withColumn("lift_id", F.col("decision_id"))
    lifts = hits.select(
        "tenant_id", "lift_id", F.col("decided_at").alias("at"),
        F.col("actor_type").alias("by_type"), F.col("actor_id").alias("by_id"),
    )
    ends = [
        hits.select("tenant_id", "lift_id", F.col(column).alias("record_no"), F.lit(end).alias("end"))
        for column, end in (("record_a", "M"), ("record_b", "C"))
    ]
    rules, sides = lift(world.rules, world.sides, lifts, ends[0].unionByName(ends[1]))
    return replace(world, rules=cut(rules), sides=cut(sides)), errors


def apply_decisions(
    world: World, decisions: DataFrame, top: int | None = None, as_cases: bool = False
) -> tuple[World, DataFrame, DataFrame]:
    """(world, events, errors) after all decisions, as if taken one by one in order of time.

    ``decisions``: tenant_id, decision_id, kind (UNMERGE, CONFIRM, REJECT, LIFT_RULE), guest_no,
    record_nos, review_id, rule_id, actor_type, actor_id, claimed_type, decided_at. Decisions that
    touch nothing in common are taken together (``waves.ready``), however many a tenant has. A
    record that founds a guest anew names it by a number drawn from the order of decisions, so
    numbers do not depend on which decisions share a wave. ``top`` is the highest number in use,
    where the world is only a part of the state. With ``as_cases`` the reviews that the last wave
    opens for crowded identifiers are counted by record in ``World.cases``, not written as pairs;
    earlier waves write theirs, because later decisions may change them.
    """
    spark = decisions.sparkSession
    checked = cut(check_actor(decisions))
    errors = checked.filter("error is not null").select("tenant_id", "decision_id", "error")
    if top is None:
        top = world.links.agg(F.max(F.greatest("record_no", "guest_no"))).first()[0] or 0
    width = F.greatest(F.lit(1), F.size(F.coalesce("record_nos", F.array().cast("array<bigint>")))).cast("long")
    accepted = checked.filter("error is null").drop("error").withColumn("width", width)
    numbered = running_total(accepted, [], ["decided_at", "tenant_id", "decision_id"], F.col("width"), "upto")
    waiting = cut(numbered.withColumn("at", F.col("upto") - F.col("width") + F.lit(top + 1)).drop("upto", "width"))
    events = spark.createDataFrame([], EVENT_SCHEMA)
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while waiting.head(1):
        now = cut(ready(world, waiting))
        rest = cut(waiting.join(now.select("tenant_id", "decision_id"), ["tenant_id", "decision_id"], "left_anti").coalesce(pieces))
        kinds = {row[0] for row in now.select("kind").distinct().collect()}
        if "UNMERGE" in kinds:
            counted = as_cases and kinds == {"UNMERGE"} and not rest.head(1)
            world, made, failed = _unmerge(world, now.filter("kind = 'UNMERGE'"), counted)
            events, errors = events.unionByName(made), errors.unionByName(failed)
        if kinds & {"CONFIRM", "REJECT"}:
            world, made, failed = _decide(world, now.filter("kind in ('CONFIRM', 'REJECT')"))
            events, errors = events.unionByName(made), errors.unionByName(failed)
        if "LIFT_RULE" in kinds:
            world, failed = _lift_rules(world, now.filter("kind = 'LIFT_RULE'"))
            errors = errors.unionByName(failed)
        waiting = rest
    return world, events, errors
