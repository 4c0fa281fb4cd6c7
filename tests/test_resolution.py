"""Named records in, expected clusters, events and reviews out."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kinfold.operators import identity, reviews
from kinfold.operators.rules import CONFIG_COLUMNS, RULE_COLUMNS
from kinfold.plans.resolve import resolve
from tests.scenarios import BASE, clusters, frame, groups, rows

OLD = datetime(2020, 1, 1)
BRIDGE = {"email": "a@example.com", "phone": "+41790000001"}

PLAIN = {
    "create": {"r1": {"email": "anna@example.com"}},
    "attach": {
        "r1": {"email": "anna@example.com"},
        "r2": {"email": "anna@example.com", "phone": "+41791234567"},
    },
    "merge": {
        "a": {"email": "shared-a@example.com"},
        "b": {"phone": "+41791112233"},
        "c": {"email": "shared-a@example.com", "phone": "+41791112233"},
    },
    "chain": {
        "r1": {"email": "x@example.com"},
        "r2": {"email": "x@example.com", "phone": "+41790000001"},
        "r3": {"phone": "+41790000001", "loyaltyId": "LOY-9"},
        "r4": {"loyaltyId": "LOY-9"},
    },
    "lonely": {"r1": {"firstName": "Anna"}},
    "separate": {"r1": {"email": "a@example.com"}, "r2": {"email": "b@example.com"}},
    "threshold2": {
        "r1": {"email": "family@example.com"},
        "r2": {"email": "family@example.com"},
        "r3": {"email": "family@example.com"},
    },
    "mixed2": {
        "f1": {"email": "family@example.com"},
        "f2": {"email": "family@example.com"},
        "p1": {"phone": "+41790000009"},
        "mix": {"phone": "+41790000009", "email": "family@example.com"},
    },
    "noise2": {
        "g1": {"phone": "+41790000009", "email": "family@example.com"},
        "g2": {"email": "family@example.com"},
        "g3": {"phone": "+41790000009", "email": "family@example.com"},
    },
    "raised": {
        "c1": {"email": "crowded@example.com"},
        "c2": {"email": "crowded@example.com"},
        "o1": {"phone": "+41790000001"},
        "bridge": {"email": "crowded@example.com", "phone": "+41790000001"},
    },
    "ignored": {
        "r1": {"email": "bookings@agency.example"},
        "r2": {"email": "bookings@agency.example"},
    },
    "perfect": {
        "r1": {"firstName": "Anna", "lastName": "Müller", "email": "vip@example.com"},
        "r2": {"firstName": "Bob", "lastName": "Meier", "email": "vip@example.com"},
        "r3": {"firstName": "ANNA", "lastName": "MÜLLER", "email": "vip@example.com"},
    },
    "perfect-clean": {
        "r1": {"firstName": "Anna", "lastName": "Müller", "email": "vip@example.com", "phone": "+41791234567"},
        "r2": {"firstName": "Bob", "lastName": "Meier", "email": "vip@example.com", "phone": "+41791234567"},
    },
    "ruled": {
        "a": BRIDGE,
        "b": {"loyaltyId": "B-1"},
        "c-bridge": {**BRIDGE, "loyaltyId": "B-1"},
    },
    "documents": {
        "r1": {"doc_type": "passport", "doc_number": "x1 23", "doc_shape": "object"},
        "r2": {"doc_type": " PASSPORT", "doc_number": "X123", "doc_shape": "object"},
    },
    "other-tenant": {"r1": {"email": "anna@example.com"}},
}

CONFIG = [
    ("threshold2", "1.000", "0.750", 2, OLD),
    ("mixed2", "1.000", "0.750", 2, OLD),
    ("noise2", "1.000", "0.750", 2, OLD),
    ("raised", "1.000", "0.750", 1, OLD),
    ("raised", "1.000", "0.750", 100, datetime(2026, 7, 9, 10, 0, 3)),
]
RULES = [
    ("ignored", "q1", "EMAIL", "EXACT", "bookings@agency.example", "IGNORE", OLD),
    ("perfect", "q2", "EMAIL", "EXACT", "vip@example.com", "PERFECT_MATCH", OLD),
    ("perfect-clean", "q3", "EMAIL", "EXACT", "vip@example.com", "PERFECT_MATCH", OLD),
]


@pytest.fixture(scope="module")
def run(spark):
    config = spark.createDataFrame(CONFIG, CONFIG_COLUMNS.replace("decimal(4,3)", "string"))
    config = config.withColumns(
        {c: F.col(c).cast("decimal(4,3)") for c in ("auto_merge_threshold", "review_floor")}
    )
    rules = spark.createDataFrame(RULES, RULE_COLUMNS)
    made = [r for tenant, records in PLAIN.items() for r in rows(tenant, records)]
    records = frame(spark, made, config, rules)
    number = {
        (r.tenant_id, r.external_key): r.record_no
        for r in records.select("tenant_id", "external_key", "record_no").collect()
    }
    a, b = number["ruled", "a"], number["ruled", "b"]
    separations = spark.createDataFrame(
        [("ruled", min(a, b), max(a, b), max(a, b) + 1, None)],
        "tenant_id string, record_a long, record_b long, since long, until long",
    )
    result = resolve(records, rules, separations)
    held = reviews.holdings(result.identifiers, result.placed, result.absorbed)
    with_threshold = result.identifiers.join(records.select("record_no", "review_threshold"), "record_no")
    crowd = reviews.crowded(with_threshold, F.col("review_threshold"))
    cases = reviews.sharing_cases(crowd, held, result.placed)
    pairs = reviews.expand(cases, held, result.placed)
    names = {v: k for k, v in number.items()}
    kinds, queued = {}, {}
    for row in result.placed.collect():
        tenant, name = names[row.record_no]
        kinds[tenant, name] = (row.kind, names[row.guest_no][1], {names[g][1] for g in row.absorbed_guests})
    for row in reviews.queue(pairs, result.vetoes).collect():
        tenant, name = names[row.record_no]
        queued.setdefault((tenant, name), {})[names[row.candidate][1]] = row.reason
    return clusters(result.links, records), kinds, queued


EXPECTED = {
    "create": groups({"r1"}),
    "attach": groups({"r1", "r2"}),
    "merge": groups({"a", "b", "c"}),
    "chain": groups({"r1", "r2", "r3", "r4"}),
    "lonely": groups({"r1"}),
    "separate": groups({"r1"}, {"r2"}),
    "threshold2": groups({"r1", "r2"}, {"r3"}),
    "mixed2": groups({"f1", "f2"}, {"p1", "mix"}),
    "noise2": groups({"g1", "g2", "g3"}),
    "raised": groups({"c1", "c2", "o1", "bridge"}),
    "ignored": groups({"r1"}, {"r2"}),
    "perfect": groups({"r1", "r3"}, {"r2"}),
    "perfect-clean": groups({"r1", "r2"}),
    "ruled": groups({"a", "c-bridge"}, {"b"}),
    "documents": groups({"r1", "r2"}),
    "other-tenant": groups({"r1"}),
}


@pytest.mark.parametrize("tenant", sorted(EXPECTED))
def test_clusters(run, tenant):
    assert run[0][tenant] == EXPECTED[tenant]


def test_every_record_is_linked_once(run):
    for tenant, records in PLAIN.items():
        linked = [name for group in run[0][tenant] for name in group]
        assert sorted(linked) == sorted(records)


def test_event_kinds(run):
    kinds = run[1]
    assert kinds["create", "r1"][0] == "CREATE"
    assert kinds["attach", "r2"] == ("ATTACH", "r1", set())
    assert kinds["merge", "c"] == ("MERGE", "a", {"b"})
    assert [kinds["chain", r][0] for r in ("r1", "r2", "r3", "r4")] == ["CREATE", "ATTACH", "ATTACH", "ATTACH"]
    assert kinds["threshold2", "r3"][0] == "CREATE"
    assert kinds["mixed2", "mix"] == ("ATTACH", "p1", set())
    assert kinds["raised", "bridge"] == ("MERGE", "c1", {"c2", "o1"})
    assert kinds["perfect", "r2"][0] == "CREATE"
    assert kinds["perfect", "r3"] == ("ATTACH", "r1", set())
    assert kinds["ruled", "c-bridge"] == ("ATTACH", "a", set())


def test_reviews(run):
    queued = run[2]
    assert queued["threshold2", "r3"] == {"r1": "identifier shared by 3 records (threshold 2)"}
    assert queued["mixed2", "mix"] == {"f1": "identifier shared by 3 records (threshold 2)"}
    assert ("noise2", "g3") not in queued and ("noise2", "g2") not in queued
    assert list(queued["raised", "c2"]) == ["c1"]
    assert "perfect-match" in queued["perfect", "r2"]["r1"]
    assert list(queued["ruled", "c-bridge"]) == ["b"]
    assert "do-not-merge" in queued["ruled", "c-bridge"]["b"]
    assert not any(t in ("ignored", "separate", "attach", "perfect-clean") for t, _ in queued)
