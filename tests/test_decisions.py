"""Steward decisions: unmerge, confirm, reject, lift, and what later records make of them."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kinfold.operators.decisions import apply_decisions
from kinfold.operators.explain import explain
from kinfold.operators.rules import CONFIG_COLUMNS
from kinfold.operators.separations import rule_pairs
from kinfold.plans.resolve import resolve
from kinfold.plans.steward import (
    pending_reviews, separations_of, sharing_review_cases, state_of, world_of,
)
from tests.scenarios import BASE, clusters, frame, groups, rows

OLD = datetime(2020, 1, 1)
SHARED = {"email": "shared@example.com"}
FIRST = {
    "one-of-three": {"r1": {**SHARED, "firstName": "Anna"}, "r2": SHARED, "r3": SHARED},
    "regroup": {
        "keep": {"email": "keep@example.com", "phone": "+41790000005"},
        "w1": {"phone": "+41790000005", "email": "wrong@example.com"},
        "w2": {"email": "wrong@example.com"},
    },
    "solo": {"r1": SHARED},
    "foreign": {"r1": SHARED, "r2": SHARED, "other": {"email": "b@example.com"}},
    "everything": {"r1": SHARED, "r2": SHARED, "r3": SHARED},
    "confirm": {"r1": SHARED, "r2": SHARED},
    "reject": {"r1": SHARED, "r2": SHARED},
    "twice": {"r1": SHARED, "r2": SHARED, "r3": SHARED},
    "fresh": {"r1": SHARED, "r2": SHARED},
    "supersede": {"r1": SHARED, "r2": SHARED},
    "rejected-bridge": {"r1": SHARED, "r2": SHARED},
    "merged-meanwhile": {
        "r1": {**SHARED, "phone": "+41791110001"},
        "r2": {**SHARED, "phone": "+41791110002"},
        "r3": {"phone": "+41791110001"},
        "r4": {"phone": "+41791110001", "loyaltyId": "X"},
        "r5": {"phone": "+41791110002", "loyaltyId": "X"},
    },
    "claimed": {"r1": SHARED, "r2": SHARED},
}
STRICT = {"confirm": 1, "reject": 1, "rejected-bridge": 1}
CONFIG = [(t, "1.000", "0.750", n, OLD) for t, n in STRICT.items()] + [
    ("everything", "1.000", "0.750", 1, BASE + timedelta(seconds=2)),
    ("merged-meanwhile", "1.000", "0.750", 1, OLD),
    ("merged-meanwhile", "1.000", "0.750", 100, BASE + timedelta(seconds=2)),
]
NOW_THRESHOLDS = {"confirm": 1, "reject": 1, "everything": 1}
DECISION = (
    "tenant_id string, decision_id string, kind string, guest_no long, record_nos array<bigint>, "
    "review_id string, rule_id string, actor_type string, actor_id string, claimed_type string, "
    "decided_at timestamp"
)


def run_all(spark):
    config = spark.createDataFrame(CONFIG, CONFIG_COLUMNS.replace("decimal(4,3)", "string"))
    config = config.withColumns(
        {c: F.col(c).cast("decimal(4,3)") for c in ("auto_merge_threshold", "review_floor")}
    )
    records = frame(spark, [r for t, rs in FIRST.items() for r in rows(t, rs)], config)
    result = resolve(records)
    cases, held = sharing_review_cases(result)
    queued = pending_reviews(result, cases, held)
    thresholds = spark.createDataFrame(list(NOW_THRESHOLDS.items()), "tenant_id string, review_threshold int")
    world = world_of(result, queued, thresholds)
    no = {(r.tenant_id, r.external_key): r.record_no for r in records.select("tenant_id", "external_key", "record_no").collect()}
    guest = {r.record_no: r.guest_no for r in result.links.collect()}
    review = {}
    for r in world.reviews.collect():
        review.setdefault((r.tenant_id, r.record_no), []).append(r.review_id)

    made = []

    def unmerge(tenant, anchor, names, claimed=None, lone=False):
        ids = [no[tenant, n] for n in names]
        made.append((tenant, f"{tenant}-{len(made)}", "UNMERGE", guest[no[tenant, anchor]], ids, None, None, "HUMAN", "sam", claimed, BASE + timedelta(hours=1, seconds=len(made))))

    def judge(tenant, name, kind):
        made.append((tenant, f"{tenant}-{len(made)}", kind, None, None, review[tenant, no[tenant, name]][0], None, "HUMAN", "sam", None, BASE + timedelta(hours=1, seconds=len(made))))

    unmerge("one-of-three", "r1", ["r3"])
    unmerge("regroup", "keep", ["w1", "w2"])
    unmerge("solo", "r1", ["r1"])
    unmerge("foreign", "r1", ["other"])
    unmerge("everything", "r1", ["r1", "r2"])
    judge("confirm", "r2", "CONFIRM")
    judge("reject", "r2", "REJECT")
    judge("reject", "r2", "CONFIRM")
    unmerge("twice", "r1", ["r3", "r3"])
    unmerge("fresh", "r1", ["r2"])
    unmerge("supersede", "r1", ["r2"])
    judge("rejected-bridge", "r2", "REJECT")
    judge("merged-meanwhile", "r2", "REJECT")
    unmerge("claimed", "r1", ["r2"], claimed="SYSTEM")
    decisions = spark.createDataFrame(made, DECISION)
    after, events, errors = apply_decisions(world, decisions)
    return locals()


@pytest.fixture(scope="module")
def first(spark):
    return run_all(spark)


@pytest.fixture(scope="module")
def found(first):
    return clusters(first["after"].links, first["records"])


EXPECTED = {
    "one-of-three": groups({"r1", "r2"}, {"r3"}),
    "regroup": groups({"keep"}, {"w1", "w2"}),
    "solo": groups({"r1"}),
    "foreign": groups({"r1", "r2"}, {"other"}),
    "everything": groups({"r1"}, {"r2"}, {"r3"}),
    "confirm": groups({"r1", "r2"}),
    "reject": groups({"r1"}, {"r2"}),
    "twice": groups({"r1", "r2"}, {"r3"}),
    "fresh": groups({"r1"}, {"r2"}),
    "rejected-bridge": groups({"r1"}, {"r2"}),
    "merged-meanwhile": groups({"r1", "r2", "r3", "r4", "r5"}),
    "claimed": groups({"r1", "r2"}),
}


@pytest.mark.parametrize("tenant", sorted(EXPECTED))
def test_clusters_after_decisions(found, tenant):
    assert found[tenant] == EXPECTED[tenant]


def test_errors(first):
    errors = {r.tenant_id: r.error for r in first["errors"].collect()}
    assert "single source record" in errors["solo"]
    assert "not linked" in errors["foreign"]
    assert "already REJECTED" in errors["reject"]
    assert errors["claimed"] == "This credential acts as HUMAN and cannot record a SYSTEM actor"
    assert set(errors) == {"solo", "foreign", "reject", "claimed"}


def test_rules_and_events(first):
    rules = {}
    for r in rule_pairs(first["after"].rules, first["after"].sides).collect():
        rules.setdefault(r.tenant_id, []).append(r)
    assert {t: len(r) for t, r in rules.items()} == {
        "one-of-three": 2, "regroup": 2, "twice": 2, "reject": 1, "fresh": 1, "supersede": 1, "rejected-bridge": 1,
    } | ({"everything": 0} if "everything" in rules else {})
    assert all(r.record_a < r.record_b and r.actor_id == "sam" for rs in rules.values() for r in rs)
    assert rules["fresh"][0].origin == "UNMERGE" and rules["reject"][0].origin == "REVIEW_REJECT"
    kinds = {}
    for e in first["events"].collect():
        kinds.setdefault(e.tenant_id, []).append(e)
    assert [e.kind for e in kinds["confirm"]] == ["REVIEW_CONFIRM"]
    assert kinds["confirm"][0].actor_id == "sam"
    unmerged = [e for e in kinds["one-of-three"] if e.kind == "UNMERGE"]
    assert len(unmerged) == 1 and unmerged[0].excluded_guests == [unmerged[0].guest_no]
    assert "claimed" not in kinds and [e.kind for e in kinds["merged-meanwhile"]] == ["REVIEW_REJECT"]


def test_reviews_follow(first):
    after = first["after"].reviews.collect()
    removed = first["guest"][first["no"]["everything", "r1"]]
    pending = [r for r in after if r.tenant_id == "everything" and r.status == "PENDING"]
    assert pending and all(r.candidate != removed for r in pending)
    assert {r.status for r in after if r.tenant_id == "reject"} == {"REJECTED"}
    merged = [r for r in after if r.tenant_id == "merged-meanwhile"]
    assert [r.status for r in merged] == ["REJECTED"]


def test_explain_reaches_absorbed_guests(spark):
    schema = "tenant_id string, guest_no long, kind string, absorbed_guests array<bigint>, created_at int"
    events = spark.createDataFrame(
        [("t", 1, "CREATE", [], 1), ("t", 2, "CREATE", [], 2), ("t", 3, "CREATE", [], 3),
         ("t", 2, "MERGE", [3], 4), ("t", 1, "MERGE", [2], 5), ("u", 3, "CREATE", [], 6)], schema)
    asked = spark.createDataFrame([("t", 1)], "tenant_id string, guest_no long")
    chain = [r.created_at for r in explain(events, asked).orderBy("created_at").collect()]
    assert chain == [1, 2, 3, 4, 5]


def test_next_batch_meets_the_rules(spark, first):
    world = first["after"]
    more = {t: {"z": SHARED} for t in ("fresh", "supersede", "rejected-bridge", "one-of-three", "confirm")}
    top = max(max(r.record_no, r.guest_no) for r in world.links.collect())
    config = first["config"].filter("tenant_id not in ('rejected-bridge', 'confirm')")
    records = frame(spark, [r for t, rs in more.items() for r in rows(t, rs, 7200)], config, start=top + 1)
    result = resolve(records, separations=separations_of(world), state=state_of(world))
    both = first["records"].select("tenant_id", "record_no", "external_key").unionByName(
        records.select("tenant_id", "record_no", "external_key"))
    seen = clusters(result.links, both)
    assert len(seen["fresh"]) == 2 and len(seen["rejected-bridge"]) == 2
    assert frozenset({"r1", "z"}) in seen["fresh"]
    assert seen["one-of-three"] == groups({"r1", "r2", "z"}, {"r3"})
    assert seen["confirm"] == groups({"r1", "r2", "z"})
    assert seen["regroup"] == EXPECTED["regroup"]
    vetoes = {r.tenant_id: r.reason for r in result.vetoes.collect()}
    assert "do-not-merge" in vetoes["fresh"] and "do-not-merge" in vetoes["rejected-bridge"]
