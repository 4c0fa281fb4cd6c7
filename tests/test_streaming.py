"""Micro-batches give what one batch gives, and replays change nothing."""

import json
import tempfile

from pyspark.sql import functions as F

from kinfold.operators.order import number_records
from kinfold.sources import runs, store
from kinfold.streaming.ingest import ENVELOPE_SCHEMA, envelope_stream, ingest_batch, start_ingest

PERSON = {"firstName": "Anna", "lastName": "Muster"}


def envelope(tenant, n, key, system="pms", **payload):
    body = {"sourceSystem": system, "externalKey": key, "payload": {**PERSON, **payload}}
    return {
        "tenant_id": tenant, "ordinal": n, "received_at": f"2026-07-09T10:00:{n:02d}.000Z",
        "body": json.dumps(body),
    }


def guests(spark, root):
    known = store.generations(spark, root)
    links = store.current_links(spark, root, known)
    keys = store.read(spark, root, "records", known).select("record_no", "external_key")
    rows = links.join(keys, "record_no").groupBy("tenant_id", "guest_no").agg(F.collect_set("external_key").alias("k")).collect()
    return {(r.tenant_id, frozenset(r.k)) for r in rows}


def test_stream_equals_batch_and_replay_is_a_no_op(spark, monkeypatch):
    monkeypatch.setattr(runs, "FAN", 2)
    monkeypatch.setattr(runs, "BUCKETS", 3)
    work = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    registry = spark.createDataFrame([("t", "pms"), ("u", "pms")], "tenant_id string, code string")
    batches = [
        [envelope("t", 1, "a", email="a@example.com"), envelope("t", 2, "b", phone="+41791112233"),
         envelope("u", 3, "a", email="a@example.com")],
        [envelope("t", 4, "c", email="a@example.com", phone="+41791112233"), envelope("t", 5, "a", email="x@example.com"),
         envelope("t", 6, "x", system="ghost"), {"tenant_id": "t", "ordinal": 7, "received_at": "2026-07-09T10:00:07.000Z", "body": "[]"}],
        [envelope("t", 8, "d", phone="+41791112233"), envelope("t", 9, "d", phone="+41791112233")],
    ]
    for n, batch in enumerate(batches):
        with open(f"{work}/in-{n}.json.tmp", "w") as out:
            out.write("\n".join(json.dumps(e) for e in batch))
    import os
    os.mkdir(f"{work}/in")
    for n in range(len(batches)):
        os.rename(f"{work}/in-{n}.json.tmp", f"{work}/in/{n}.json")
        os.utime(f"{work}/in/{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    query = start_ingest(envelope_stream(spark, f"{work}/in"), f"{work}/state", f"{work}/progress", registry)
    query.awaitTermination()
    assert query.exception() is None
    streamed = guests(spark, f"{work}/state")
    assert streamed == {("t", frozenset("abcd")), ("u", frozenset("a"))}
    assert [p.level for p in runs.cover(spark, f"{work}/state", [0, 1, 2])] == [1, 0]
    report = store.read(spark, f"{work}/state", "report").orderBy("ordinal").collect()
    assert [r.status for r in report] == [
        "CREATED_GUEST", "CREATED_GUEST", "CREATED_GUEST", "MERGED", "DUPLICATE_IGNORED", "ERROR", "ERROR",
        "ATTACHED", "DUPLICATE_IGNORED",
    ]
    assert report[4].guest_id == report[3].guest_id == report[7].guest_id
    assert report[6].error == "Each record must be a JSON object"
    whole = spark.createDataFrame([], ENVELOPE_SCHEMA).unionByName(spark.read.schema(ENVELOPE_SCHEMA).json(f"{work}/in"))
    assert ingest_batch(whole, f"{work}/state", 1, registry) is None
    ingest_batch(whole, f"{work}/again", 0, registry)
    assert guests(spark, f"{work}/again") == streamed
