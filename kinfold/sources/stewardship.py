"""Steward decisions on the stored state, and the review queue read from it.

A batch of decisions loads what it touches, applies it (operators/decisions.py) and publishes a
generation of its own: records that changed their guest, guests that were absorbed, rules made and
taken away, reviews decided or opened, events and errors. A decision that was published before is
skipped. Reviews are append-only rows; which guest a review means now is found at read time through
the absorptions, and of several that mean one pair the newest counts. Fuzzy reviews are stored as
classes: a case (look, holder) and who is in either; a pair is looked up when someone names it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinfold import schemas as V
from kinfold.operators import rules as trust
from kinfold.operators.decisions import REVIEW_SCHEMA, World, apply_decisions
from kinfold.operators.separations import RULE_SCHEMA, SIDE_SCHEMA, in_force, named_pairs
from kinfold.plans.resolve import PERSON_COLUMNS, Outcome, _effects, final_guests
from kinfold.operators.scoring import fuzzy_cases
from kinfold.session import cut
from kinfold.sources import runs, store
from kinfold.sources.extract import block_key_rows, identifier_rows
from kinfold.sources.runs import Part

PAIR = ["tenant_id", "record_no", "candidate"]
SET = ["tenant_id", "set_id"]
REVIEW_NAME = r"^(-?[0-9]{1,18}):(-?[0-9]{1,18})(:[0-9]+)?$"


def fuzzy_tables(done: Outcome, new: DataFrame) -> dict[str, DataFrame]:
    """Cases that new records open, and the members of the classes they speak of."""
    fuzzy, key = done.fuzzy, ["tenant_id", "look"]
    looks = fuzzy.members.join(new.select("record_no"), "record_no", "left_semi").select(*key).distinct()
    cases = cut(fuzzy_cases(fuzzy.scored).join(looks, key, "left_semi"))
    blocks = block_key_rows(fuzzy.looks, "look").select(*key, "rank", "value")
    cases = cut(cases.join(blocks, [*key, "rank"]))
    asked = fuzzy.members.join(cases.select(*key).distinct(), key, "left_semi").select(*key, "record_no", F.col("guest_no").alias("own"))
    held = fuzzy.members.join(cases.select("tenant_id", "holder").distinct(), ["tenant_id", "holder"], "left_semi")
    held = held.groupBy("tenant_id", "holder", F.col("guest_no").alias("candidate")).agg(F.min("record_no").alias("first_no"))
    new_only = asked.join(new.select("record_no"), "record_no", "left_semi")
    return {"fuzzy_cases": cases, "fuzzy_records": new_only, "fuzzy_holders": held}


def read_rules(spark: SparkSession, root: str, known: list[int]) -> tuple[DataFrame, DataFrame]:
    """(rules, sides) that decisions have left: what was made, less what a lift has cut up."""
    rules = store.read_any(spark, root, "rules", known, RULE_SCHEMA)
    sides = store.read_any(spark, root, "sides", known, SIDE_SCHEMA)
    dropped = store.read_any(spark, root, "dropped", known, "tenant_id string, set_id string")
    return rules.join(dropped, SET, "left_anti"), sides.join(dropped, SET, "left_anti")


def separations(spark: SparkSession, root: str, known: list[int]) -> DataFrame | None:
    """Sides of the rules in force, as the next batch meets them; null while there are none."""
    found = cut(in_force(*read_rules(spark, root, known)))
    return found if found.head(1) else None


def _living(spark: SparkSession, parts: list[Part], pairs: DataFrame) -> DataFrame:
    """Pairs with the guest that their candidate has become."""
    moved = runs.survivors(spark, parts, pairs.select(F.col("candidate").alias("guest_no")))
    return pairs.withColumnRenamed("candidate", "guest_no").join(moved, "guest_no").drop("guest_no").withColumnRenamed("survivor", "candidate")


def stored_reviews(spark: SparkSession, root: str, known: list[int], parts: list[Part], records: DataFrame) -> DataFrame:
    """Reviews of the given records (tenant_id, record_no): decided ones, and the pending pairs of
    rules, unmerges and scores, by living candidate; one per record and candidate is pending."""
    key = ["tenant_id", "record_no"]
    records = cut(records.select(*key).distinct())
    nothing = {"status": F.lit("PENDING"), "decided_at": F.lit(None).cast("timestamp"), "decision_id": F.lit(None).cast("string")}
    kept = store.read_any(spark, root, "reviews", known, f"{REVIEW_SCHEMA}, generation long")
    rows = kept.join(records, key, "left_semi")
    vetoes = store.read_any(
        spark, root, "vetoes", known, "tenant_id string, record_no long, candidate long, origin_type string, "
        "origin_value string, reason string, matcher string, confidence decimal(4,3)",
    ).join(records, key, "left_semi")
    cases = store.read_any(
        spark, root, "fuzzy_cases", known, "tenant_id string, look string, holder string, rank int, value string, "
        "confidence decimal(4,3), reason string, matcher string",
    )
    looked = store.read_any(spark, root, "fuzzy_records", known, "tenant_id string, look string, record_no long, own long")
    held = store.read_any(spark, root, "fuzzy_holders", known, "tenant_id string, holder string, candidate long, first_no long")
    kinds = F.array(*[F.lit(k) for k in V.BLOCK_KEY_TYPES])
    scored = (
        looked.join(records, key, "left_semi").join(cases, ["tenant_id", "look"]).join(held, ["tenant_id", "holder"])
        .filter("candidate <> own and first_no < record_no")
        .select(
            *PAIR, kinds[F.col("rank")].alias("origin_type"), F.col("value").alias("origin_value"), "reason", "matcher", "confidence",
        )
    )
    opened = vetoes.unionByName(scored.select(*vetoes.columns)).withColumns(nothing).withColumn(
        "review_id", F.concat_ws(":", F.col("record_no").cast("string"), F.col("candidate").cast("string"))
    ).withColumn("generation", F.lit(-1).cast("long"))
    # The newest word on a review counts; a pair that scores opened in several batches is one.
    said = cut(opened.select(*rows.columns).unionByName(rows))
    newest = said.groupBy("tenant_id", "review_id").agg(
        F.max_by(F.struct(*[c for c in said.columns if c not in ("tenant_id", "review_id")]), F.struct("generation", "confidence")).alias("r")
    ).select("tenant_id", "review_id", "r.*")
    # A pair that was decided under another name of the guest is pending only if it was opened since.
    newest = cut(newest)
    answered = _living(spark, parts, newest.filter("status <> 'PENDING'")).groupBy(*PAIR).agg(F.max("generation").alias("answered"))
    pending = _living(spark, parts, newest.filter("status = 'PENDING'")).join(answered, PAIR, "left")
    pending = pending.filter("answered is null or generation > answered").drop("answered", "generation")
    newest = newest.drop("generation")
    own = runs.placements(spark, parts, records)
    own = own.join(runs.survivors(spark, parts, own), "guest_no").select(*key, F.col("survivor").alias("own"))
    pending = pending.join(own, key).filter("candidate <> own").drop("own")
    names = [c for c in newest.columns if c not in PAIR]
    one = pending.groupBy(*PAIR).agg(F.min_by(F.struct(*names), "review_id").alias("r")).select(*PAIR, "r.*")
    columns = [c for c in kept.columns if c != "generation"]
    return cut(one.select(*columns).unionByName(newest.filter("status <> 'PENDING'").select(*columns)))


def _touched(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, guests) that decisions name: (tenant_id, record_no) and (tenant_id, guest_no)."""
    told = [F.regexp_extract("review_id", REVIEW_NAME, k) for k in (1, 2)]
    judged = decisions.select(
        "tenant_id", F.when(told[0] != "", told[0]).cast("long").alias("record_no"),
        F.when(told[1] != "", told[1]).cast("long").alias("guest_no"),
    )
    ruled = named_pairs(decisions.select("tenant_id", "rule_id"))
    records = (
        decisions.select("tenant_id", F.explode("record_nos").alias("record_no")).unionByName(judged.select("tenant_id", "record_no"))
        .unionByName(ruled.select("tenant_id", F.col("record_a").alias("record_no")))
        .unionByName(ruled.select("tenant_id", F.col("record_b").alias("record_no")))
    )
    guests = decisions.select("tenant_id", "guest_no").unionByName(judged.select("tenant_id", "guest_no"))
    return records.filter("record_no is not null").distinct(), guests.filter("guest_no is not null").distinct()


def load_world(
    spark: SparkSession, root: str, known: list[int], parts: list[Part], decisions: DataFrame,
    thresholds: DataFrame, trust_rules: DataFrame | None = None,
) -> World:
    """What the decisions can touch: guests named, guests of records named, and every guest that
    shares an identifier with one of these, whole."""
    records, guests = (cut(part) for part in _touched(decisions))
    came = cut(runs.placements(spark, parts, records).select("guest_no").unionByName(guests.select("guest_no")))
    near = runs.survivors(spark, parts, came).select(F.col("survivor").alias("guest_no"))
    people, _ = store.people_of(spark, parts, near)
    keys = cut(store.identifier_keys(identifier_rows(people, "record_no")))
    carriers = cut(runs.probe(spark, parts, runs.KEYS, keys).select("record_no").distinct())
    around = cut(runs.placements(spark, parts, carriers).select("guest_no").unionByName(came))
    around = runs.survivors(spark, parts, around).select(F.col("survivor").alias("guest_no"))
    people, links = store.people_of(spark, parts, around)
    people = cut(people)
    heard = _effects(identifier_rows(people, "record_no"), trust_rules)
    identifiers = heard.filter(~trust.silenced(F.col("effect"))).withColumn(
        "gated", F.coalesce(F.col("effect") == "PERFECT_MATCH", F.lit(False))
    ).drop("effect")
    rules, sides = read_rules(spark, root, known)
    mine = sides.join(links.select("record_no"), "record_no", "left_semi").select(*SET).distinct()
    rules, sides = cut(rules.join(mine, SET, "left_semi")), cut(sides.join(mine, SET, "left_semi"))
    reviews = stored_reviews(spark, root, known, parts, records)
    return World(people, cut(identifiers), links, rules, sides, reviews, thresholds)


def decide(
    spark: SparkSession, root: str, decisions: DataFrame, thresholds: DataFrame | None = None,
    trust_rules: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame] | None:
    """Apply a batch of decisions to the store; (events, errors), null if all were applied before.

    ``decisions`` as in ``apply_decisions``; ``thresholds`` (tenant_id, review_threshold) where a
    tenant's sharing threshold is not the default.
    """
    known = store.generations(spark, root)
    parts = runs.cover(spark, root, known)
    before = store.read_any(spark, root, "decided", known, "tenant_id string, decision_id string")
    fresh = cut(decisions.join(before, ["tenant_id", "decision_id"], "left_anti"))
    if not fresh.head(1):
        return None
    if thresholds is None:
        thresholds = spark.createDataFrame([], "tenant_id string, review_threshold int")
    world = load_world(spark, root, known, parts, fresh, thresholds, trust_rules)
    top = store.highest_number(spark, root, known)
    after, events, errors = apply_decisions(world, fresh, top)
    events, errors = cut(events), cut(errors)
    generation = max(known) + 1
    stamp = F.lit(generation).cast("long").alias("generation")
    old = world.links.select("record_no", F.col("guest_no").alias("was"))
    moved = after.links.join(old, "record_no", "left").filter("was is null or was <> guest_no")
    placed = cut(moved.select("tenant_id", "record_no", "guest_no", stamp))
    absorbed = cut(events.select(
        F.explode("absorbed_guests").alias("absorbed"), F.lit(None).cast("long").alias("at"), F.col("guest_no").alias("survivor")
    ))
    said = [c for c in world.reviews.columns if c != "candidate"]
    changed = after.reviews.join(world.reviews.select(*said), said, "left_anti")
    tables = {
        "placed": placed,
        "moves": final_guests(absorbed).select(F.col("guest_no").alias("absorbed"), "survivor"),
        "rules": after.rules.join(world.rules.select(*SET), SET, "left_anti"),
        "sides": after.sides.join(world.rules.select(*SET), SET, "left_anti"),
        "dropped": world.rules.select(*SET).join(after.rules.select(*SET), SET, "left_anti"),
        "reviews": changed.select("*", stamp),
        "events": events,
        "errors": errors,
        "decided": fresh.select("tenant_id", "decision_id").distinct(),
    }
    given = placed.agg(F.max("guest_no")).first()[0]
    store.publish(spark, root, generation, tables, None, max(top, -1 if given is None else given))
    runs.compact(spark, root, store.generations(spark, root))
    return events, errors
