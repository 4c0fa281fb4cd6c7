"""The registered queries: every operator over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinfold import schemas as V
from kinfold.functions import text as X
from kinfold.operators import (
    identity, paging, reviews, rules as trust, scoring, survivorship, timeline,
)
from kinfold.operators.explain import explain
from kinfold.operators.order import number_records
from kinfold.operators.separations import rule_pairs, separate
from kinfold.operators.settle import spanning_pairs
from kinfold.plans import decision_queries as decided
from kinfold.plans.resolve import fuzzy_pass, prepare, resolve
from kinfold.plans.steward import sharing_review_cases
from kinfold.session import configure, cut
from kinfold.sources import envelope
from kinfold.sources.extract import (
    block_key_rows, extract, identifier_rows, reason_rows, with_optional_columns,
)
from kinfold.sources.feeds import numbered_person_feed, object_feed, person_feed, table

THRESHOLD = V.DEFAULT_REVIEW_THRESHOLD


def _people(spark: SparkSession, folder: str) -> DataFrame:
    return extract(person_feed(configure(spark), folder))


IDENTIFIER_COLUMNS = [
    "email_identifier", "phone_norm", "loyalty_identifier", "external_identifier", "document_identifier",
]


# What ``resolve`` reads of records beside their identifiers, if no rule can veto a match.
RESOLUTION_COLUMNS = ["review_threshold"]


def _numbered(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """The record table: the feed numbered in arrival order, then extracted once.

    Of what is extracted only the named ``columns`` beside the identifiers are made, all if none are named.
    """
    records = prepare(extract(numbered_person_feed(configure(spark), folder)))
    if columns is not None:
        records = records.select("tenant_id", "record_no", "ord", *IDENTIFIER_COLUMNS, *columns)
    return cut(records)


def _ids(records: DataFrame) -> DataFrame:
    return identifier_rows(records, "record_no")


def _links(records: DataFrame) -> DataFrame:
    """(tenant_id, record_no, guest_no) by connected components."""
    carriers = identity.first_carriers(_ids(records), THRESHOLD)
    edges = identity.identity_edges(carriers, F.lit(THRESHOLD))
    return cut(identity.clusters(records, edges))


def _founder(df: DataFrame, records: DataFrame, number: str = "guest_no", name: str = "founder") -> DataFrame:
    """Replace a guest number by the order that founded the guest."""
    names = records.select(F.col("record_no").alias(number), F.col("ord").alias(name))
    return df.join(names, number).drop(number)


def _ntz(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz").alias(column)


# --- extraction -------------------------------------------------------------


def identifiers_extracted(spark, folder):
    return identifier_rows(_people(spark, folder), "ord").drop("rank")


def needs_review_reasons(spark, folder):
    return reason_rows(_people(spark, folder), "ord")


def observation_dedup(spark, folder):
    lines = table(configure(spark), folder, "lineitem").select(
        F.concat(F.lit("sys"), (F.col("l_orderkey") % 4).cast("string")).alias("source_system"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("external_key"),
        F.col("l_linenumber").alias("stored_line"), F.col("l_partkey").alias("stored_part"), "l_suppkey",
    )
    return envelope.first_observations(
        lines, ["source_system", "external_key"], F.struct("stored_line", "stored_part", "l_suppkey"),
        "stored_line", "stored_part",
    )


def block_keys(spark, folder):
    return block_key_rows(_people(spark, folder), "ord").drop("rank")


def block_keys_phonetic(spark, folder):
    keys = block_key_rows(_people(spark, folder), "ord").drop("rank")
    return keys.filter("type = 'NAME_PHONETIC_BIRTHYEAR'")


def document_contacts(spark, folder):
    found = F.regexp_extract_all(
        "text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), 0
    )
    documents = table(configure(spark), folder, "documents").filter(F.col("text").contains("@"))
    contacts = documents.select("doc_id", F.explode(found).alias("raw"))
    return (
        contacts.select("doc_id", F.lit("EMAIL").alias("type"), X.email(F.col("raw")).alias("value"))
        .filter("value is not null").distinct()
    )


def ingest_outcomes(spark, folder):
    """Every order once as an envelope and once more as its repetition, some of them broken."""
    return envelope.batch_report(envelope.order_envelopes(configure(spark), folder))


def object_identity_reasons(spark, folder):
    parsed = envelope.parse(envelope.order_envelopes(configure(spark), folder))
    # A filter on the parsed columns, or one that explode implies, would be pushed below the parsing
    # and parse the body once more for each of its fields.
    reasons = F.when(F.col("error").isNull(), F.col("object_reasons"))
    return (
        parsed.select("tenant_id", "externalKey", F.explode_outer(reasons).alias("reason"))
        .filter("reason is not null")
    )


# --- identity ---------------------------------------------------------------


def identifier_sharing(spark, folder):
    ids = identifier_rows(_people(spark, folder), "ord").withColumnRenamed("ord", "record_no")
    return identity.sharing_counts(ids)


def over_threshold_carriers(spark, folder):
    records = _numbered(spark, folder, [])
    ids = identifier_rows(records, "record_no", "ord")
    return reviews.crowded(ids, F.lit(THRESHOLD)).select(
        "tenant_id", "ord", "type", "value", "sharing", "reason"
    )


def founding_records(spark, folder):
    records = _numbered(spark, folder, [])
    carriers = identity.first_carriers(_ids(records), THRESHOLD)
    later = carriers.filter("sharing > 1").select("record_no")
    return records.join(later, "record_no", "left_anti").select("tenant_id", "ord")


def _trust_rules(spark, folder):
    """Rules on loyalty ids, one per supplier."""
    key = F.col("s_suppkey")
    return table(configure(spark), folder, "supplier").select(
        F.when(key % 2 == 0, "acme").otherwise("globex").alias("tenant_id"),
        key.cast("string").alias("rule_id"), F.lit("LOYALTY_ID").alias("identifier_type"),
        F.lit("EXACT").alias("match_kind"), F.concat(F.lit("l"), key.cast("string")).alias("value"),
        F.when(key % 3 == 0, "PERFECT_MATCH").otherwise("IGNORE").alias("effect"),
        F.lit("2020-01-01").cast("timestamp").alias("created_at"),
    )


def identifier_effects(spark, folder):
    ids = identifier_rows(_people(spark, folder), "ord").drop("rank")
    judged = trust.identifier_effects(ids, _trust_rules(spark, folder)).filter("effect is not null")
    return judged.withColumn("silenced", trust.silenced(F.col("effect")))


def silenced_identifiers(spark, folder):
    return (
        identifier_effects(spark, folder).filter("silenced")
        .groupBy("tenant_id", "type", "value").agg(F.count(F.lit(1)).alias("records"))
    )


def guest_clusters(spark, folder):
    records = _numbered(spark, folder, [])
    links = _links(records).join(records.select("record_no", "ord"), "record_no").drop("record_no")
    return _founder(links, records).select("tenant_id", "ord", "founder")


def resolution_events(spark, folder):
    """CREATE, ATTACH or MERGE of every order, as if they had come one by one."""
    records = _numbered(spark, folder, RESOLUTION_COLUMNS)
    result = resolve(records)
    placed = result.placed.join(records.select("record_no", "ord"), "record_no")
    placed = placed.withColumn("absorbed", F.size("absorbed_guests")).drop("absorbed_guests", "record_no")
    return _founder(placed, records).select("tenant_id", "ord", "kind", "founder", "absorbed")


def review_cases(spark, folder):
    """Doubtful identifiers of every order with the number of guests it may be."""
    records = _numbered(spark, folder, RESOLUTION_COLUMNS)
    cases, _ = sharing_review_cases(resolve(records))
    return cases.join(records.select("record_no", "ord"), "record_no").select(
        "tenant_id", "ord", "origin_type", "origin_value", "reason", "matcher", "confidence", "candidates"
    )


def _evidence(spark, folder):
    records = _numbered(spark, folder, RESOLUTION_COLUMNS)
    result = resolve(records)
    carriers = identity.first_carriers(result.identifiers, THRESHOLD)
    held = cut(reviews.holdings(result.identifiers, result.placed, result.absorbed))
    return records, result, reviews.match_evidence(carriers, held, result.placed, F.lit(THRESHOLD))


def match_evidence(spark, folder):
    """Through which identifiers every order matched, and how many records shared them then."""
    records, _, rows = _evidence(spark, folder)
    named = rows.join(records.select("record_no", "ord"), "record_no")
    return named.select("tenant_id", "ord", "type", "value", "sharing", "reason")


def decision_log(spark, folder):
    """Every decision with its matcher, confidence and number of matching identifiers."""
    records, result, rows = _evidence(spark, folder)
    log = reviews.decision_events(result.placed, rows)
    named = log.join(records.select("record_no", "ord"), "record_no")
    named = named.withColumn("absorbed", F.size("absorbed_guests"))
    return _founder(named, records).select(
        "tenant_id", "ord", "kind", "founder", "absorbed", "matcher", "confidence", "matches",
        "actor_type", "actor_id",
    )


def _customers(spark, folder, **fields):
    key = F.col("c_custkey")
    df = table(configure(spark), folder, "customer").select(
        F.lit("acme").alias("tenant_id"), F.lit("crm").alias("source_system"),
        F.concat(F.lit("c"), key.cast("string")).alias("external_key"), "c_custkey",
        F.lit("2026-01-01").cast("timestamp").alias("record_timestamp"),
        *[value.alias(name) for name, value in fields.items()],
    )
    return cut(prepare(extract(number_records(with_optional_columns(df), "record_timestamp", "c_custkey"))))


def _customer_guests(records, links):
    named = links.drop("tenant_id").join(records.select("record_no", "c_custkey"), "record_no")
    founders = records.select(F.col("record_no").alias("guest_no"), F.col("c_custkey").alias("founder"))
    return named.join(founders, "guest_no").select("c_custkey", "founder")


def perfect_match_gate(spark, folder):
    """Four customers share each loyalty id, which a rule ties to exact name agreement."""
    key = F.col("c_custkey")
    shared = F.concat(F.lit("L"), F.floor(key / 4).cast("string"))
    records = _customers(
        spark, folder, loyaltyId=shared, lastName=F.lit("Muster"),
        firstName=F.concat(F.lit("Anna"), F.translate((key % 3).cast("string"), "012", "abc")),
    )
    rules = records.select(
        "tenant_id", F.lower("loyaltyId").alias("rule_id"), F.lit("LOYALTY_ID").alias("identifier_type"),
        F.lit("EXACT").alias("match_kind"), F.lower("loyaltyId").alias("value"),
        F.lit("PERFECT_MATCH").alias("effect"), F.col("record_timestamp").alias("created_at"),
    ).distinct()
    return _customer_guests(records, resolve(records, rules).links)


def do_not_merge_gate(spark, folder):
    """Customers by threes: the third would join the first two, unless a rule keeps them apart."""
    key, group = F.col("c_custkey"), F.floor(F.col("c_custkey") / 3)
    place = key % 3
    records = _customers(
        spark, folder,
        email=F.when(place != 1, F.concat(F.lit("e"), group.cast("string"), F.lit("@example.com"))),
        loyaltyId=F.when(place != 0, F.concat(F.lit("L"), group.cast("string"))),
    )
    numbered = records.withColumn("grp", F.floor(F.col("c_custkey") / 3))
    separations = numbered.filter("grp % 2 = 0 and c_custkey % 3 < 2").groupBy("tenant_id", "grp").agg(
        F.min("record_no").alias("record_a"), F.max("record_no").alias("record_b")
    ).filter("record_a < record_b").select(
        "tenant_id", "record_a", "record_b", (F.col("record_b") + 1).alias("since"),
        F.lit(None).cast("long").alias("until"),
    )
    return _customer_guests(records, resolve(records, separations=separations).links)


# --- guests -----------------------------------------------------------------

PROFILE_COLUMNS = [
    "firstName", "lastName", "birth_iso", "email_kept", "phone_kept", "loyaltyId", "externalGuestId",
    "city", "email_masked", "effective_at", "received_at",
]


def _profiles(spark, folder):
    records = _numbered(spark, folder, PROFILE_COLUMNS)
    linked = records.join(_links(records).select("record_no", "guest_no"), "record_no")
    fields = survivorship.field_rows(linked, "tenant_id", "guest_no", "record_no", "effective_at", "received_at")
    return records, survivorship.golden_profile(fields)


def golden_profile(spark, folder):
    records, profile = _profiles(spark, folder)
    return _founder(profile, records).select("tenant_id", "founder", "field", "value")


def golden_email_masked_guard(spark, folder):
    records, profile = _profiles(spark, folder)
    wide = profile.filter("field in ('email', 'emailMasked')").groupBy("tenant_id", "guest_no").agg(
        F.max(F.when(F.col("field") == "email", F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v"))).alias("email"),
        F.coalesce(F.bool_or(F.col("field") == "emailMasked"), F.lit(False)).alias("masked"),
    )
    return _founder(wide, records).select("tenant_id", "founder", "email", "masked")


def guest_profiles(spark, folder):
    """How many guests are there, and what is each one's golden profile?"""
    records = _numbered(spark, folder, PROFILE_COLUMNS)
    linked = records.join(_links(records).drop("tenant_id"), "record_no")
    wide = survivorship.matching_profile(linked)
    sized = survivorship.link_counts(linked).join(wide, ["tenant_id", "guest_no"])
    return _founder(sized, records)


def guest_identifiers(spark, folder):
    records = _numbered(spark, folder, [])
    mine = survivorship.guest_identifiers(_ids(records), _links(records))
    return _founder(mine, records).select("tenant_id", "founder", "type", "value")


def guest_view(spark, folder):
    records = _numbered(spark, folder, [])
    view = survivorship.guest_view(_ids(records), _links(records))
    return _founder(view, records).select("tenant_id", "founder", "records", "type", "value")


def guest_lookup(spark, folder):
    records = _numbered(spark, folder, [])
    key = F.col("c_custkey").cast("string")
    customers = table(configure(spark), folder, "customer")
    asked = customers.select(
        F.concat(F.lit(" CUST"), key, F.lit("@EXAMPLE.com")).alias("raw"), F.lit("EMAIL").alias("type")
    ).unionByName(
        customers.select(F.concat(F.lit("L"), key).alias("raw"), F.lit("LOYALTY_ID").alias("type"))
    )
    mine = survivorship.guest_identifiers(_ids(records), _links(records))
    found = envelope.lookup_candidates(asked).join(mine.drop("rank"), ["type", "value"])
    return _founder(found, records).select("raw", "tenant_id", "founder").distinct()


def records_of_guest(spark, folder):
    records = _numbered(spark, folder, ["external_key", "source_system", "record_timestamp"])
    links = _links(records)
    mine = survivorship.records_of_guests(records, links, links)
    return _founder(mine, records).select(
        "tenant_id", "founder", "external_key", "source_system", "record_timestamp"
    )


# --- fuzzy ------------------------------------------------------------------


def _unlinked_scores(spark, folder, auto: str, floor: str):
    """Scores between records that are each their own guest, through all five blocking keys."""
    records = _numbered(spark, folder).withColumns(
        {
            "auto_merge_threshold": F.lit(auto).cast("decimal(4,3)"),
            "review_floor": F.lit(floor).cast("decimal(4,3)"),
            "guest_no": F.col("record_no"),
        }
    )
    looks, holders, members = (cut(part) for part in scoring.sides(records))
    of_look = cut(
        members.join(records.select("record_no", "ord"), "record_no").groupBy("tenant_id", "look").agg(
            F.min("ord").alias("look_ord")
        )
    )
    of_holder = of_look.withColumnsRenamed({"look": "holder", "look_ord": "holder_ord"})
    looks = looks.join(of_look, ["tenant_id", "look"])
    holders = holders.join(of_holder, ["tenant_id", "holder"])
    names = ("look_ord", "holder_ord")
    pairs = scoring.candidate_pairs(looks, holders, members, also=names)
    return scoring.score_pairs(pairs, looks, holders, names).filter("band <> 'DISCARD'")


def fuzzy_scores(spark, folder):
    return _unlinked_scores(spark, folder, "1.000", "0.750").select(
        "tenant_id", "look_ord", "holder_ord", "rank", "score"
    )


def fuzzy_bands(spark, folder):
    return _unlinked_scores(spark, folder, "0.900", "0.800").groupBy("tenant_id", "band").agg(
        F.count(F.lit(1)).alias("pairs"), F.min("score").alias("lowest"), F.max("score").alias("highest")
    )


def fuzzy_reviews(spark, folder):
    """Scored cases left after the deterministic pass, with what the score is made of."""
    records = _numbered(spark, folder)
    fuzzy = fuzzy_pass(records, _links(records))
    sizes = fuzzy.looks.select("tenant_id", "look", "records")
    guests = fuzzy.holders.select("tenant_id", "holder", "guests")
    return (
        scoring.fuzzy_cases(fuzzy.scored).join(sizes, ["tenant_id", "look"])
        .join(guests, ["tenant_id", "holder"]).drop("rank")
    )


# --- rules, reviews, decisions ----------------------------------------------


def rule_spanning_pairs(spark, folder):
    records = _numbered(spark, folder, [])
    numbers = records.select("record_no", "ord", "tenant_id")
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg((F.max("l_partkey") * 7).alias("other"))
    a = numbers.select(F.col("record_no").alias("record_a"), F.col("ord").alias("l_orderkey"), "tenant_id")
    b = numbers.select(F.col("record_no").alias("record_b"), F.col("ord").alias("other"), "tenant_id")
    ruled = lines.join(a, "l_orderkey").join(b, ["other", "tenant_id"])
    apart = spanning_pairs(ruled.select("tenant_id", "record_a", "record_b"), _links(records))
    named = _founder(_founder(apart, records, "guest_low", "x"), records, "guest_high", "y")
    return named.select("tenant_id", F.least("x", "y").alias("guest_low"), F.greatest("x", "y").alias("guest_high")).distinct()


def _crowd_reviews(spark, folder):
    records = _numbered(spark, folder, ["record_timestamp"])
    ids = identifier_rows(records, "record_no", "ord", "record_timestamp")
    crowd = reviews.crowded(ids, F.lit(THRESHOLD))
    return crowd.select(
        "tenant_id", F.concat_ws(":", F.col("ord").cast("string"), "type").alias("review_id"),
        F.col("record_timestamp").alias("created_at"), "record_no",
    )


def review_page(spark, folder):
    queue = _crowd_reviews(spark, folder).withColumn("status", F.lit("PENDING"))
    after = (F.lit("1995-01-01 00:00:00").cast("timestamp_ntz"), "")
    return paging.review_page(queue, limit=50, after=after).select("tenant_id", "review_id", "created_at")


def review_counts(spark, folder):
    status = F.when(F.col("ord") % 3 == 0, "CONFIRMED").otherwise("PENDING")
    queue = _crowd_reviews(spark, folder).withColumn(
        "ord", F.substring_index("review_id", ":", 1).cast("long")
    )
    return reviews.counts_by_status(queue.withColumn("status", status))


def rule_table(spark, folder):
    """A do-not-merge rule per line item, of which the returned ones were lifted."""
    lines = table(configure(spark), folder, "lineitem")
    name = F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return lines.select(
        F.when(F.col("l_suppkey") % 2 == 0, "acme").otherwise("globex").alias("tenant_id"),
        name.alias("rule_id"), F.col("l_shipdate").alias("created_at"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("lifted_at"),
    )


def rule_page(spark, folder):
    return paging.rule_page(rule_table(spark, folder), limit=50).select("tenant_id", "rule_id", "created_at")


def rule_counts(spark, folder):
    return paging.rule_counts(rule_table(spark, folder))


def unmerge_rules(spark, folder):
    """The rules written if the newest order of every guest were detached from it."""
    records = _numbered(spark, folder, [])
    links = _links(records)
    sized = links.groupBy("tenant_id", "guest_no").agg(
        F.max("record_no").alias("record_no"), F.count(F.lit(1)).alias("n")
    )
    detached = sized.filter("n > 1").select(
        "tenant_id", F.concat(F.lit("d"), F.col("guest_no").cast("string")).alias("decision_id"), "guest_no",
        "record_no", F.lit("HUMAN").alias("actor_type"), F.lit("sam").alias("actor_id"),
        F.lit("2026-01-01").cast("timestamp").alias("decided_at"),
    )
    staying = links.join(detached.select("record_no"), "record_no", "left_anti")
    remaining = detached.select("tenant_id", "decision_id", "guest_no").join(staying, ["tenant_id", "guest_no"])
    made = rule_pairs(*separate(detached, remaining, "UNMERGE")).select("tenant_id", "record_a", "record_b")
    named = _founder(_founder(made, records, "record_a", "a"), records, "record_b", "b")
    return named.select("tenant_id", F.col("a").alias("record_a"), F.col("b").alias("record_b"))


def _decided(query):
    """A query over the orders of the feed and the guests they form."""

    def run(spark, folder):
        records = _numbered(spark, folder, decided.NAME_COLUMNS)
        return query(spark, records, _links(records))

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def explain_chain(spark, folder):
    """Parts as guests, each taken over by the one of a quarter of its number."""
    parts = table(configure(spark), folder, "part").select(F.col("p_partkey").alias("guest_no"))
    taken = parts.select(F.floor(F.col("guest_no") / 4).alias("parent"), "guest_no").filter("parent <> guest_no")
    into = taken.join(parts.select(F.col("guest_no").alias("parent")), "parent", "left_semi")
    merged = into.groupBy(F.col("parent").alias("guest_no")).agg(F.collect_list("guest_no").alias("absorbed_guests"))
    events = parts.join(merged, "guest_no", "left").select(
        F.lit("acme").alias("tenant_id"), "guest_no",
        F.when(F.col("absorbed_guests").isNull(), "CREATE").otherwise("MERGE").alias("kind"),
        F.coalesce("absorbed_guests", F.array().cast("array<bigint>")).alias("absorbed_guests"),
    )
    chain = explain(events, events.select("tenant_id", "guest_no"))
    return chain.select("asked", F.col("guest_no").alias("guest"), "kind")


def config_as_of(spark, folder):
    key = F.col("n_nationkey")
    config = table(configure(spark), folder, "nation").select(
        F.when(key % 2 == 0, "acme").otherwise("globex").alias("tenant_id"),
        (F.lit(0.8) + key % 20 / 100).cast("decimal(4,3)").alias("auto_merge_threshold"),
        F.lit("0.700").cast("decimal(4,3)").alias("review_floor"), (key % 6).cast("int").alias("review_threshold"),
        (F.lit("1993-01-01").cast("timestamp") + F.make_dt_interval(key * 90)).alias("effective_from"),
    )
    feed = person_feed(spark, folder).select("tenant_id", "ord", "record_timestamp")
    return trust.config_in_force(feed, config, "record_timestamp").drop("record_timestamp")


# --- timeline ---------------------------------------------------------------


def _observations(spark, folder):
    return object_feed(configure(spark), folder).withColumns(
        {"tenant_id": F.lit("acme"), "business_end": F.lit(None).cast("timestamp"),
         "effective_ts": F.col("effective_ts").cast("timestamp")}
    )


def _shown(df):
    return df.select(
        "source_system", "object_type", "object_id", "object_role", "guest_id", "status",
        "successor_guest_id", "object_position", _ntz("object_version"), "observation_count",
        _ntz("ordering_time"), *[c for c in ("place",) if c in df.columns],
    )


def current_roster(spark, folder):
    return timeline.current_roster(_observations(spark, folder)).select(
        "source_system", "object_type", "object_id", "object_role", "object_position", "guest_id", "record_id"
    )


def timeline_current(spark, folder):
    return _shown(timeline.associations(_observations(spark, folder)).filter("status = 'CURRENT'"))


def timeline_ended(spark, folder):
    return _shown(timeline.associations(_observations(spark, folder)).filter("status = 'ENDED'"))


def timeline_page(spark, folder):
    return _shown(timeline.timeline_pages(timeline.associations(_observations(spark, folder)), 50))


def object_view(spark, folder):
    return timeline.object_view(_observations(spark, folder)).select(
        "source_system", "object_type", "object_id", "record_id", "guest_id", _ntz("current_version"),
        _ntz("current_start"), "on_roster",
    )


def object_counts(spark, folder):
    return _observations(spark, folder).groupBy("source_system", "object_type", "object_id", "object_role").agg(
        F.count(F.lit(1)).alias("observations"), F.count_distinct("guest_id").alias("guests")
    )


def observations_for_guests(spark, folder):
    asked = table(configure(spark), folder, "nation").filter("n_regionkey = 1").select(
        F.lit("acme").alias("tenant_id"), F.concat(F.lit("g"), F.col("n_nationkey").cast("string")).alias("guest_id")
    )
    seen = timeline.observations_for_guests(_observations(spark, folder), asked)
    return seen.select("record_id", "object_id", "guest_id")


QUERIES = {
    f.__name__: f
    for f in (
        identifiers_extracted, needs_review_reasons, observation_dedup, block_keys,
        block_keys_phonetic, document_contacts, ingest_outcomes, object_identity_reasons,
        identifier_sharing, over_threshold_carriers, founding_records, identifier_effects,
        silenced_identifiers, guest_clusters, resolution_events, review_cases, match_evidence, decision_log, perfect_match_gate,
        do_not_merge_gate, golden_profile, golden_email_masked_guard, guest_profiles,
        guest_identifiers, guest_view, guest_lookup, records_of_guest, fuzzy_scores, fuzzy_bands,
        fuzzy_reviews, rule_spanning_pairs, review_page, review_counts, rule_page, rule_counts,
        unmerge_rules, explain_chain, config_as_of, current_roster, timeline_current,
        timeline_ended, timeline_page, object_view, object_counts, observations_for_guests,
        *map(_decided, decided.DECISION_QUERIES),
    )
}
