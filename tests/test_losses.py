"""Cases in which data or decisions once got lost without a word."""

import json
import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kinfold.functions import text as X
from kinfold.operators import scoring, survivorship
from kinfold.operators.decisions import check_actor
from kinfold.operators.paging import page
from kinfold.operators.rules import CONFIG_COLUMNS
from kinfold.operators.timeline import timeline_pages
from kinfold.plans.resolve import automatic_merges, fuzzy_pass, resolve
from kinfold.sources import envelope, store
from kinfold.streaming.ingest import ENVELOPE_SCHEMA, envelope_stream, start_ingest
from tests.scenarios import clusters, frame, groups, rows

OLD = datetime(2020, 1, 1)


def test_unknown_kinds_are_errors(spark):
    kinds = ["UNMERGE", "CONFIRM", "REJECT", "LIFT_RULE", "unmerge", None, *(f"K{n}" for n in range(9))]
    df = spark.createDataFrame([(k, "STEWARD", None) for k in kinds], "kind string, actor_type string, claimed_type string")
    errors = {r.kind: r.error for r in check_actor(df).collect()}
    assert [k for k, e in errors.items() if e is None] == kinds[:4]
    assert errors["K3"] == "No such kind of decision: K3"


def test_restarted_stream_is_ingested(spark):
    work = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    registry = spark.createDataFrame([("t", "pms")], "tenant_id string, code string")

    def send(folder, key):
        body = json.dumps({"sourceSystem": "pms", "externalKey": key, "payload": {"email": f"{key}@example.com"}})
        row = (("t", 1, datetime(2026, 7, 9), body),)
        spark.createDataFrame(row, ENVELOPE_SCHEMA).coalesce(1).write.json(f"{work}/{folder}")

    for n, key in enumerate("abc"):
        send(f"in{n}", key)
        stream = envelope_stream(spark, f"{work}/in{n}")
        start_ingest(stream, f"{work}/state", f"{work}/progress{n}", registry).awaitTermination()
    start_ingest(envelope_stream(spark, f"{work}/in2"), f"{work}/state", f"{work}/progress2", registry).awaitTermination()
    found = store.read(spark, f"{work}/state", "records").collect()
    assert sorted(r.externalKey for r in found) == ["a", "b", "c"]
    assert store.generations(spark, f"{work}/state") == [0, 1, 2]


@pytest.mark.parametrize("limit", [0, -1, 201])
def test_pages_refuse_other_limits(spark, limit):
    df = spark.createDataFrame([], "tenant_id string, guest_id long, ordering_time timestamp, ordering_key string")
    with pytest.raises(ValueError):
        timeline_pages(df, limit)
    with pytest.raises(ValueError):
        page(df, "ordering_time", "ordering_key", limit)


def test_a_large_position_is_one_rows_matter(spark):
    bodies = [
        json.dumps({"sourceSystem": "s", "externalKey": "k", "payload": {}, "sourceObject": {"type": "r", "id": "1", "role": "BOOKER", "position": p, "version": "2026-01-01T24:00:00Z"}})
        for p in (3_000_000_000, 1e300, 2)
    ]
    df = spark.createDataFrame([("t", n, b) for n, b in enumerate(bodies)], "tenant_id string, ordinal long, body string")
    found = envelope.parse(df).orderBy("ordinal").collect()
    assert [(r.object_position, r.error) for r in found] == [(None, None), (None, None), (2, None)]
    assert found[0].object_version == datetime(2026, 1, 2)


def test_instants(spark):
    read = {
        "2026-01-01T24:00:00Z": datetime(2026, 1, 2), "2026-01-01T24:00:00.000Z": datetime(2026, 1, 2),
        "2026-01-01T24:00:01Z": None, "2026-01-01T10:00:00+02": None,
        "2026-01-01T10:00:00+02:00": datetime(2026, 1, 1, 8), "2026-01-01T10:00:00": None,
    }
    df = spark.createDataFrame([(k,) for k in read], "c string")
    assert {r.c: r.t for r in df.select("c", X.iso_instant(F.col("c")).alias("t")).collect()} == read


def test_unicode_blanks_replace_nothing(spark):
    schema = "tenant_id string, guest_no long, effective_at timestamp, received_at timestamp, record_no long, email_masked boolean, field string, value string"
    at = [datetime(2026, 1, n) for n in (1, 2)]
    values = ['"Anna"', '" \\t"']
    df = spark.createDataFrame([("t", 1, at[n], at[n], n, False, "firstName", v) for n, v in enumerate(values)], schema)
    assert [r.value for r in survivorship.golden_profile(df).collect()] == ['"Anna"']


ANNA = {"firstName": "Anna", "lastName": "Müller", "birthdate": "1985-03-12"}
ANN2 = {**ANNA, "lastName": "Mueller"}


def test_silenced_identifiers_decide_nothing(spark):
    people = [{**ANNA, "loyaltyId": "L1"}, {**ANN2, "loyaltyId": "L1"}]
    records = frame(spark, rows("t", {"r1": people[0], "r2": people[1]}))
    rules = spark.createDataFrame(
        [("t", "q1", "LOYALTY_ID", "EXACT", "l1", "IGNORE", OLD)],
        "tenant_id string, rule_id string, identifier_type string, match_kind string, value string, effect string, created_at timestamp",
    )
    result = resolve(records, rules)
    assert clusters(result.links, records)["t"] == groups({"r1"}, {"r2"})
    assert fuzzy_pass(records, result.links).scored.count() == 0
    scored = fuzzy_pass(records, result.links, rules=rules).scored.collect()
    assert [(r.band, str(r.score)) for r in scored] == [("REVIEW", "0.934")]


def test_barred_merges_are_queued(spark):
    config = spark.createDataFrame([("t", "0.850", "0.750", 10, OLD)], CONFIG_COLUMNS.replace("decimal(4,3)", "string"))
    config = config.withColumns({c: F.col(c).cast("decimal(4,3)") for c in ("auto_merge_threshold", "review_floor")})
    records = frame(spark, rows("t", {"r1": ANNA, "r2": ANN2}), config)
    result = resolve(records)
    numbers = {r.external_key: r.record_no for r in records.select("external_key", "record_no").collect()}
    apart = spark.createDataFrame(
        [("t", numbers["r1"], numbers["r2"], 0, None)], "tenant_id string, record_a long, record_b long, since long, until long"
    )
    fuzzy = fuzzy_pass(records, result.links)
    links, merges = automatic_merges(fuzzy, result.links, apart)
    assert clusters(links, records)["t"] == groups({"r1"}, {"r2"}) and not merges.head(1)
    assert scoring.fuzzy_cases(fuzzy.scored).count() == 1


def outcomes(report):
    return {r.external_key: (r.status, r.review_cases) for r in report.collect()}


def person(key, **payload):
    return json.dumps({"sourceSystem": "pms", "externalKey": key, "payload": payload})


def test_outcomes_name_fuzzy_reviews(spark):
    """In one batch, and against people of an earlier one."""
    from kinfold.streaming.ingest import ingest_batch

    registry = spark.createDataFrame([("t", "pms")], "tenant_id string, code string")
    at = datetime(2026, 7, 9)
    bodies = [
        person("r1", **ANNA), person("r2", **ANN2), person("r3", firstName="Eva", lastName="Roth", birthdate="1990-01-01"),
    ]
    rows_ = [("t", n, at.replace(hour=n), b) for n, b in enumerate(bodies)]
    want = {"r1": ("CREATED_GUEST", None), "r2": ("CREATED_GUEST", "NAME_PHONETIC_BIRTHYEAR"), "r3": ("CREATED_GUEST", None)}
    work = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    whole = ingest_batch(spark.createDataFrame(rows_, ENVELOPE_SCHEMA), f"{work}/one", None, registry)
    found = outcomes(whole)
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in want.items()}
    assert found["r1"][1] is None and found["r3"][1] is None and found["r2"][1]
    for n, row in enumerate(rows_[:2]):
        part = ingest_batch(spark.createDataFrame([row], ENVELOPE_SCHEMA), f"{work}/two", None, registry)
        assert outcomes(part)[f"r{n + 1}"] == found[f"r{n + 1}"]
    merged = spark.createDataFrame([("t", "0.850", "0.750", 10, OLD)], CONFIG_COLUMNS.replace("decimal(4,3)", "string"))
    merged = merged.withColumns({c: F.col(c).cast("decimal(4,3)") for c in ("auto_merge_threshold", "review_floor")})
    for row in rows_[:2]:
        ingest_batch(spark.createDataFrame([row], ENVELOPE_SCHEMA), f"{work}/auto", None, registry, merged)
    links = store.current_links(spark, f"{work}/auto", store.generations(spark, f"{work}/auto"))
    assert links.select("guest_no").distinct().count() == 1
