"""A batch of records resolved against everything resolved before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from kinfold import schemas as V
from kinfold.operators import identity, reviews, rules as trust, scoring
from kinfold.operators.components import connected_components
from kinfold.operators.separations import as_sides, crossed
from kinfold.operators.settle import settle
from kinfold.session import cut
from kinfold.sources.extract import identifier_rows

PERSON_COLUMNS = [
    "tenant_id", "record_no", "firstName", "lastName", "birth_iso", "birth_date", "phone_kept",
    "phone_norm", "email_kept", "email_norm", "email_masked", "masked", "city", "first_fold",
    "last_fold", "city_fold", "email_identifier", "loyalty_identifier", "external_identifier",
    "document_identifier", "effective_at", "received_at", "review_threshold",
    "auto_merge_threshold", "review_floor",
]


@dataclass
class Resolution:
    """What a batch produced.

    ``links`` covers all records, old and new; ``moved`` maps absorbed guests to the guest that
    lives on; ``placed`` and ``absorbed`` are the decision log of the new records.
    """

    records: DataFrame
    identifiers: DataFrame
    links: DataFrame
    placed: DataFrame
    absorbed: DataFrame
    moved: DataFrame
    vetoes: DataFrame
    edges: DataFrame


@dataclass
class State:
    """What earlier batches left: people (PERSON_COLUMNS), identifiers and links."""

    people: DataFrame
    identifiers: DataFrame
    links: DataFrame


def prepare(
    records: DataFrame, config: DataFrame | None = None
) -> DataFrame:
    """Numbered, extracted records with effective times and the settings in force."""
    df = records
    if "received_at" not in df.columns:
        df = df.withColumn("received_at", F.col("record_timestamp"))
    df = df.withColumn("effective_at", F.coalesce("record_timestamp", "received_at"))
    if config is None:
        return df.withColumns(
            {
                "auto_merge_threshold": F.lit(V.DEFAULT_AUTO_MERGE).cast("decimal(4,3)"),
                "review_floor": F.lit(V.DEFAULT_REVIEW_FLOOR).cast("decimal(4,3)"),
                "review_threshold": F.lit(V.DEFAULT_REVIEW_THRESHOLD),
            }
        )
    return trust.config_in_force(df, config, "received_at")


def _effects(identifiers: DataFrame, rules: DataFrame | None) -> DataFrame:
    if rules is not None:
        return trust.identifier_effects(identifiers, rules)
    domain = F.substring_index("value", "@", -1)
    masked = (F.col("type") == "EMAIL") & domain.isin(V.RELAY_DOMAINS)
    return identifiers.withColumn("effect", F.when(masked, "MASKED_ALIAS"))


def _carriers(new: DataFrame, state: State | None) -> DataFrame:
    """New and touched earlier carriers; earlier ones stand for the guest they belong to."""
    fresh = new.withColumns({"node": F.col("record_no"), "settled": F.lit(False)})
    if state is None:
        carriers = fresh
    else:
        touched = state.identifiers.join(
            new.select(*identity.IDENTIFIER, "gated").distinct(), identity.IDENTIFIER
        )
        known = touched.join(state.links.select("record_no", F.col("guest_no").alias("node")), "record_no")
        known = known.withColumns({"settled": F.lit(True), "review_threshold": F.lit(0)})
        carriers = fresh.unionByName(known.select(*fresh.columns))
    highest = new.agg(F.max("review_threshold")).first()[0] or 0
    return identity.first_carriers(carriers, int(highest))


def _contested(
    edges: DataFrame, roots: DataFrame, records: DataFrame, rules: DataFrame | None,
    links: DataFrame | None,
) -> DataFrame | None:
    """Roots of the groups whose outcome may depend on the order of arrival."""
    found = []
    gated = edges.filter("gated")
    if gated.head(1):
        of_gate = gated.select(F.col("later").alias("node")).join(roots, "node").select("root").distinct()
        named = (
            roots.join(of_gate, "root", "left_semi")
            .join(records.select(F.col("record_no").alias("node"), "first_fold", "last_fold"), "node", "left")
            .groupBy("root")
            .agg(
                F.bool_and(F.col("first_fold").isNotNull() & F.col("last_fold").isNotNull()).alias("full"),
                F.min(F.struct("first_fold", "last_fold")).alias("low"),
                F.max(F.struct("first_fold", "last_fold")).alias("high"),
            )
        )
        found.append(named.filter("not full or low <> high").select("root"))
    if rules is not None and rules.head(1):
        nodes = records.select("record_no", F.col("record_no").alias("guest_no"))
        if links is not None:
            nodes = nodes.unionByName(links.select("record_no", "guest_no"))
        members = as_sides(rules).join(nodes, "record_no").join(roots.withColumnRenamed("node", "guest_no"), "guest_no")
        found.append(crossed(members))
    if not found:
        return None
    union = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    roots_found = cut(union.distinct())
    return roots_found if roots_found.head(1) else None


def resolve(
    records: DataFrame,
    rules: DataFrame | None = None,
    separations: DataFrame | None = None,
    state: State | None = None,
) -> Resolution:
    """Link every new record to a guest, as if the records had come one by one.

    Where nothing can veto a match the order does not matter and connected components give the
    answer. Groups that hold a perfect-match identifier with differing names, or both ends of a
    do-not-merge rule, are settled in order. ``separations`` are the sides of do-not-merge rules
    (tenant_id, set_id, side, record_no, since, until) or their pairs (record_a, record_b).
    """
    spark = records.sparkSession
    all_ids = _effects(identifier_rows(records, "record_no", "review_threshold"), rules)
    heard = all_ids.filter(~trust.silenced(F.col("effect"))).withColumn(
        "gated", F.coalesce(F.col("effect") == "PERFECT_MATCH", F.lit(False))
    ).drop("effect")
    heard = cut(heard)
    carriers = cut(_carriers(heard, state))
    threshold = F.col("review_threshold")
    edges = cut(identity.identity_edges(carriers, threshold))
    roots = connected_components(identity.identity_pairs(edges))
    old_links = state.links if state is not None else None
    contested = _contested(edges, roots, records, separations, old_links)

    plain_edges, plain_records, settled_links, outcomes = edges, records, None, None
    if contested is not None:
        inside = cut(roots.join(contested, "root", "left_semi").select("node"))
        hot = inside.select(F.col("node").alias("later"))
        plain_edges = edges.join(hot, "later", "left_anti")
        mine = inside.select(F.col("node").alias("record_no"))
        plain_records = records.join(mine, "record_no", "left_anti")
        turns = records.join(mine, "record_no", "left_semi").select(
            "tenant_id", F.col("record_no").alias("turn"), "record_no"
        )
        near = carriers.join(inside, "node", "left_semi")
        matches = identity.all_earlier_carriers(near, threshold).select(
            F.col("record_no").alias("turn"), "record_no", "rank", "type", "value", "gated", "earlier"
        )
        before = spark.createDataFrame([], "record_no long, guest_no long")
        people = records.select(*PERSON_COLUMNS).join(mine, "record_no", "left_semi")
        if state is not None:
            guests = inside.select(F.col("node").alias("guest_no"))
            before = state.links.join(guests, "guest_no", "left_semi").select("record_no", "guest_no")
            people = people.unionByName(
                state.people.join(before.select("record_no"), "record_no", "left_semi").select(*PERSON_COLUMNS)
            )
        outcomes, settled_links = settle(turns, matches, before, people, separations)

    home = cut(identity.homes(plain_edges))
    absorbed = identity.absorptions(plain_edges, home)
    placed = identity.placements(plain_records, home, absorbed)
    vetoes = spark.createDataFrame(
        [],
        "tenant_id string, record_no long, candidate long, origin_type string, "
        "origin_value string, reason string, matcher string, confidence decimal(4,3)",
    )
    if outcomes is not None:
        placed = placed.unionByName(outcomes.select(*placed.columns))
        absorbed = absorbed.unionByName(
            outcomes.select(
                F.explode("absorbed_guests").alias("absorbed"), F.col("turn").alias("at"),
                F.col("guest_no").alias("survivor"),
            )
        )
        vetoes = reviews.veto_reviews(outcomes)
    placed, absorbed = cut(placed), cut(absorbed)
    moved = cut(final_guests(absorbed))
    links = placed.select("tenant_id", "record_no", "guest_no")
    if state is not None:
        links = links.unionByName(state.links.select("tenant_id", "record_no", "guest_no"))
    links = cut(
        links.join(moved, "guest_no", "left").select(
            "tenant_id", "record_no", F.coalesce("survivor", "guest_no").alias("guest_no")
        )
    )
    known = heard.select("tenant_id", "rank", "type", "value", "record_no")
    return Resolution(records, known, links, placed, absorbed, moved, vetoes, edges)


def final_guests(absorbed: DataFrame) -> DataFrame:
    """(guest_no, survivor): absorbed guests and the guest that lives on in the end."""
    pointers = absorbed.select(F.col("absorbed").alias("child"), F.col("survivor").alias("parent"))
    return identity._roots(pointers).select(
        F.col("child").alias("guest_no"), F.col("root").alias("survivor")
    )


@dataclass
class FuzzyPass:
    looks: DataFrame
    holders: DataFrame
    members: DataFrame
    scored: DataFrame


def fuzzy_pass(
    people: DataFrame,
    links: DataFrame,
    arriving: DataFrame | None = None,
    matcher=None,
    rules: DataFrame | None = None,
) -> FuzzyPass:
    """Score what identifiers left undecided, against profiles after the deterministic pass.

    Identifiers that ``rules`` silence leave their records undecided too.
    ``matcher`` may replace the scorer: it takes (pairs, looks, holders) and returns pairs with
    score and band, so bands, gates and reviews stay shared.
    """
    linked = people.join(links.select("record_no", "guest_no"), "record_no")
    if rules is not None:
        ids = _effects(identifier_rows(people, "record_no"), rules)
        mute = ids.filter(trust.silenced(F.col("effect"))).groupBy("record_no").agg(
            F.collect_set(F.concat_ws(":", "type", "value")).alias("silenced")
        )
        linked = linked.join(mute, "record_no", "left")
    looks, holders, members = (cut(part) for part in scoring.sides(linked))
    fresh = None
    if arriving is not None:
        fresh = members.join(arriving.select("record_no"), "record_no", "left_semi").select(
            "tenant_id", "look"
        ).distinct()
    pairs = scoring.candidate_pairs(looks, holders, members, arriving=fresh)
    scored = cut((matcher or scoring.score_pairs)(pairs, looks, holders))
    return FuzzyPass(looks, holders, members, scored)


@dataclass
class Outcome:
    """Links after scoring, the merges by score, and (tenant_id, record_no, origin_type) of all reviews."""

    links: DataFrame
    merges: DataFrame
    opened: DataFrame
    fuzzy: FuzzyPass


def finish(
    result: Resolution, sharing: DataFrame, rules: DataFrame | None = None,
    separations: DataFrame | None = None, neighbours: tuple[DataFrame, DataFrame] | None = None,
) -> Outcome:
    """Score a resolved batch and gather every review it opens.

    ``sharing`` are the cases of crowded identifiers. ``neighbours`` are (people, links) of earlier
    batches that share a blocking key with the batch; they are scored against, not anew.
    """
    people, links = result.records.select(*PERSON_COLUMNS), result.links
    if neighbours is not None:
        old_people, old_links = neighbours
        old = old_links.join(result.moved, "guest_no", "left").select(
            "tenant_id", "record_no", F.coalesce("survivor", "guest_no").alias("guest_no")
        )
        old = old.join(links.select("record_no"), "record_no", "left_anti")
        links = cut(links.unionByName(old))
        people = cut(people.unionByName(old_people.select(*PERSON_COLUMNS)).dropDuplicates(["record_no"]))
    fuzzy = fuzzy_pass(people, links, result.records, rules=rules)
    links, merges = automatic_merges(fuzzy, links, separations)
    new = result.records.select("record_no")
    scored = scoring.opened_cases(scoring.fuzzy_cases(fuzzy.scored), fuzzy.looks, fuzzy.members)
    opened = (
        sharing.select("tenant_id", "record_no", "origin_type")
        .unionByName(result.vetoes.select("tenant_id", "record_no", "origin_type").distinct())
        .unionByName(scored.join(new, "record_no", "left_semi"))
    )
    return Outcome(links, merges, cut(opened), fuzzy)


def automatic_merges(
    fuzzy: FuzzyPass, links: DataFrame, separations: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(links, merges) after the pairs above a tenant's threshold have joined their guests.

    A group in which a do-not-merge rule separates two guests is left as it is; its pairs become
    review pairs of ``fuzzy.scored``.
    """
    edges = cut(scoring.merge_pairs(fuzzy.scored, fuzzy.members))
    empty = links.sparkSession.createDataFrame([], "guest_no long, survivor long, confidence decimal(4,3)")
    if not edges.head(1):
        return links, empty
    roots = connected_components(edges.select("a", "b"))
    if separations is not None and separations.head(1):
        sides = as_sides(separations).filter("until is null").join(links.select("record_no", "guest_no"), "record_no")
        barred = cut(crossed(sides.join(roots.withColumnRenamed("node", "guest_no"), "guest_no")))
        held = roots.join(barred, "root", "left_semi").select(F.col("node").alias("guest_no"))
        parted = (
            fuzzy.members.join(held, "guest_no", "left_semi").select("tenant_id", "look").distinct()
            .withColumn("parted", F.lit(True))
        )
        band = F.when(F.col("parted") & (F.col("band") == "AUTO_MERGE"), "REVIEW").otherwise(F.col("band"))
        fuzzy.scored = cut(
            fuzzy.scored.join(parted, ["tenant_id", "look"], "left").withColumn("band", band).drop("parted")
        )
        roots = roots.join(barred, "root", "left_anti")
    weakest = edges.select("a", "score").unionByName(edges.select(F.col("b").alias("a"), "score"))
    weakest = weakest.groupBy("a").agg(F.max("score").alias("confidence"))
    merges = cut(
        roots.filter("node <> root").join(weakest.withColumnRenamed("a", "node"), "node").select(
            F.col("node").alias("guest_no"), F.col("root").alias("survivor"), "confidence"
        )
    )
    moved = links.join(merges.select("guest_no", "survivor"), "guest_no", "left").select(
        "tenant_id", "record_no", F.coalesce("survivor", "guest_no").alias("guest_no")
    )
    return cut(moved), merges
