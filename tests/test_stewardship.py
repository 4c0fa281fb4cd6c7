"""Decisions that last: fuzzy reviews confirmed and rejected, unmerges, and later batches that obey."""

import json
import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kinfold.sources import runs, stewardship, store
from kinfold.streaming.ingest import ENVELOPE_SCHEMA, ingest_batch
from tests.test_waves import asked

ANNA = {"firstName": "Anna", "lastName": "Muster", "birthdate": "1980-05-01", "city": "Basel"}


def batch(spark, n, *people):
    rows = [
        (p.pop("tenant", "t"), k, datetime(2026, 7, 9, n, k), json.dumps({"sourceSystem": "pms", "externalKey": p.pop("key"), "payload": p}))
        for k, p in enumerate(people)
    ]
    return spark.createDataFrame(rows, ENVELOPE_SCHEMA)


def clusters(spark, root):
    known = store.generations(spark, root)
    names = store.read_any(spark, root, "records", known, "record_no long, externalKey string")
    rows = store.current_links(spark, root, known).join(names, "record_no")
    return {frozenset(r.k) for r in rows.groupBy("guest_no").agg(F.collect_set("externalKey").alias("k")).collect()}


@pytest.fixture(scope="module")
def life(spark):
    patch = pytest.MonkeyPatch()
    patch.setattr(runs, "FAN", 2)
    patch.setattr(runs, "BUCKETS", 3)
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    registry = spark.createDataFrame([("t", "pms")], "tenant_id string, code string")
    told = {}

    def numbers():
        known = store.generations(spark, root)
        return {r.externalKey: r.record_no for r in store.read_any(spark, root, "records", known, "record_no long, externalKey string").collect()}

    def queue(*keys):
        known = store.generations(spark, root)
        no = numbers()
        who = spark.createDataFrame([("t", no[k]) for k in keys], "tenant_id string, record_no long")
        return stewardship.stored_reviews(spark, root, known, runs.cover(spark, root, known), who).collect()

    ingest_batch(batch(
        spark, 1,
        {"key": "a1", **ANNA, "email": "anna@example.com"},
        {"key": "x1", "email": "x@example.com", "lastName": "Roth"}, {"key": "x2", "email": "x@example.com"}, {"key": "x3", "email": "x@example.com"},
        {"key": "a2", **ANNA, "email": "anna.muster@example.org"}, {"key": "a3", **ANNA, "email": "third@example.net"},
    ), root, None, registry)
    no = numbers()
    told["opened"] = queue("a2", "a3")
    pair = {(r.record_no, r.candidate): r.review_id for r in told["opened"]}
    told["pairs"] = sorted(pair)
    made = [
        ("CONFIRM", pair[no["a2"], no["a1"]]), ("REJECT", pair[no["a3"], no["a1"]]),
        ("UNMERGE", (no["x1"], [no["x3"]])), ("CONFIRM", "77777:1"), ("UNMERGE", (no["x1"], [no["a1"]])),
    ]
    told["events"], told["errors"] = (df.collect() for df in stewardship.decide(spark, root, asked(spark, made)))
    told["again"] = stewardship.decide(spark, root, asked(spark, made))
    told["after"] = clusters(spark, root)
    told["left"] = queue("a2", "a3")
    ingest_batch(batch(
        spark, 4, {"key": "x4", "email": "x@example.com"}, {"key": "a4", "email": "anna@example.com", "phone": "+41791112233"},
        {"key": "a5", "email": "third@example.net", "phone": "+41791112233"},
    ), root, None, registry)
    told["later"] = clusters(spark, root)
    told["parted"] = queue("a5")
    told["no"], told["levels"] = numbers(), [p.level for p in runs.cover(spark, root, store.generations(spark, root))]
    yield told
    patch.undo()


def test_fuzzy_reviews_are_stored_as_pairs_to_decide(life):
    no = life["no"]
    assert (no["a2"], no["a1"]) in life["pairs"] and (no["a3"], no["a1"]) in life["pairs"]
    assert all(r.status == "PENDING" and r.reason.startswith("score ") and r.confidence is not None for r in life["opened"])


def test_decisions_are_in_the_store(life):
    assert life["after"] == {frozenset({"a1", "a2"}), frozenset({"a3"}), frozenset({"x1", "x2"}), frozenset({"x3"})}
    assert sorted(e.kind for e in life["events"]) == ["CREATE", "REVIEW_CONFIRM", "REVIEW_REJECT", "UNMERGE"]
    assert {e.decision_id: e.error.split(" ")[0] for e in life["errors"]} == {"d0003": "No", "d0004": "Source"}


def test_a_batch_of_decisions_counts_once(life):
    assert life["again"] is None


def test_reviews_follow_the_living_guest(life):
    """a2 has joined a1; what is left of a3's queue means that guest, and the rejected pair is no pending one."""
    no = life["no"]
    states = {(r.record_no, r.candidate): r.status for r in life["left"]}
    assert states[no["a2"], no["a1"]] == "CONFIRMED" and states[no["a3"], no["a1"]] == "REJECTED"


def test_later_batches_obey_the_rules(life):
    """x4 joins the older side of the split; a5 shares identifiers with both sides of a rejection."""
    assert frozenset({"x1", "x2", "x4"}) in life["later"] and frozenset({"x3"}) in life["later"]
    assert not any({"a1", "a3"} <= c for c in life["later"])
    assert any("do-not-merge" in r.reason for r in life["parted"])


def test_generations_are_merged(life):
    assert life["levels"] == [1, 0]
