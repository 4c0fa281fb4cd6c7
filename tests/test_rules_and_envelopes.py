"""Settings, trust rules, source systems and envelope validation."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from kinfold.operators import rules as trust
from kinfold.sources import envelope
from kinfold.sources.extract import extract

OLD, NEW = datetime(2020, 1, 1), datetime(2021, 1, 1)


def test_config_changes_hold_from_their_time(spark):
    config = spark.createDataFrame(
        [("t", "0.900", "0.700", 5, OLD), ("t", "0.500", "0.700", 5, NEW), ("t", "0.800", "0.700", 3, datetime(2022, 1, 1))],
        trust.CONFIG_COLUMNS.replace("decimal(4,3)", "string"),
    ).withColumns({c: F.col(c).cast("decimal(4,3)") for c in ("auto_merge_threshold", "review_floor")})
    assert [r.error for r in trust.checked_config(config).orderBy("effective_from").collect()] == [None, "reviewFloor must not exceed autoMergeThreshold", None]
    at = spark.createDataFrame([("t", 1, datetime(2019, 1, 1)), ("t", 2, datetime(2021, 6, 1)), ("t", 3, datetime(2022, 1, 1)), ("u", 4, NEW)], "tenant_id string, n int, at timestamp")
    rows = trust.config_in_force(at, config, "at").orderBy("n").collect()
    assert [(str(r.auto_merge_threshold), r.review_threshold) for r in rows] == [("1.000", 10), ("0.900", 5), ("0.800", 3), ("1.000", 10)]


def test_rule_maintenance(spark):
    columns = trust.RULE_COLUMNS
    kept = spark.createDataFrame([("t", "1", "EMAIL", "EXACT", "a@x.org", "IGNORE", OLD)], columns)
    asked = spark.createDataFrame([
        ("t", "2", "EMAIL", "EMAIL_DOMAIN", " Relay.Example ", "MASKED_ALIAS", NEW),
        ("t", "3", "PHONE", "EMAIL_DOMAIN", "x", "IGNORE", NEW),
        ("t", "4", "EMAIL", "EXACT", "x", "MASKED_ALIAS", NEW),
        ("t", "5", "EMAIL", "EXACT", "A@x.org", "PERFECT_MATCH", NEW),
        ("t", "6", "EMAIL", "EMAIL_DOMAIN", "relay.example", "IGNORE", NEW),
        ("t", "7", "FAX", "EXACT", "x", "IGNORE", NEW)], columns)
    good, bad = trust.checked_rules(asked, kept)
    assert [(r.rule_id, r.value) for r in good.collect()] == [("2", "relay.example")]
    errors = {r.rule_id: r.error for r in bad.collect()}
    assert errors["3"].startswith("EMAIL_DOMAIN rules") and errors["4"].startswith("MASKED_ALIAS rules")
    assert errors["5"] == errors["6"] == "An equivalent rule already exists" and "7" in errors
    gone = spark.createDataFrame([("t", "1")], "tenant_id string, rule_id string")
    now = trust.changed_rules(kept, asked, gone)
    assert [r.rule_id for r in now.collect()] == ["2"]
    listed = trust.rule_list(now, now).orderBy("priority").collect()
    assert len(listed) == 10 and listed[0].value == "guest.booking.com" and listed[-1].rule_id == "2"


def test_first_rule_wins(spark):
    rules = spark.createDataFrame([
        ("t", "1", "EMAIL", "EXACT", "x@guest.booking.com", "IGNORE", OLD),
        ("t", "2", "EMAIL", "EMAIL_DOMAIN", "agency.example", "PERFECT_MATCH", OLD),
        ("t", "3", "EMAIL", "EXACT", "a@agency.example", "IGNORE", NEW),
        ("t", "4", "LOYALTY_ID", "EXACT", "l-9", "IGNORE", NEW)], trust.RULE_COLUMNS)
    ids = spark.createDataFrame([
        ("t", "EMAIL", "x@guest.booking.com"), ("t", "EMAIL", "a@agency.example"), ("t", "LOYALTY_ID", "L-9"),
        ("u", "EMAIL", "a@agency.example"), ("t", "PHONE", "+41791234567")], "tenant_id string, type string, value string")
    found = {(r.tenant_id, r.value): r.effect for r in trust.identifier_effects(ids, rules).collect()}
    assert found == {("t", "x@guest.booking.com"): "MASKED_ALIAS", ("t", "a@agency.example"): "PERFECT_MATCH",
                     ("t", "L-9"): "IGNORE", ("u", "a@agency.example"): None, ("t", "+41791234567"): None}
    literal = trust.identifier_effects(ids, rules, lower_cased_values=True)
    assert literal.filter("value = 'L-9'").first().effect is None


def test_source_systems(spark):
    known = spark.createDataFrame([("t", "pms", "PMS")], "tenant_id string, code string, name string")
    asked = spark.createDataFrame([("t", "crm", "CRM"), ("t", "PMS!", "x"), ("t", "pms", "x"), ("u", "pms", "x")], known.schema)
    errors = {(r.tenant_id, r.code): r.error for r in envelope.check_registry(asked, known).collect()}
    assert errors["t", "crm"] is None and errors["u", "pms"] is None
    assert "kebab-case" in errors["t", "PMS!"] and "already registered" in errors["t", "pms"]


BASE = {"sourceSystem": "pms", "externalKey": "k", "payload": {}}
BLOCK = {"type": "reservation", "id": "R1", "role": "booker", "version": "2026-01-01T00:00:00Z", "position": 2}
BODIES = {
    "list": [1], "no-system": {"externalKey": "k", "payload": {}}, "blank-key": {**BASE, "externalKey": " "},
    "number-key": {**BASE, "externalKey": 5}, "no-payload": {"sourceSystem": "pms", "externalKey": "k"},
    "bad-time": {**BASE, "recordTimestamp": "2026-01-01"}, "bad-block": {**BASE, "sourceObject": "x"},
    "plain": BASE, "null-block": {**BASE, "sourceObject": None}, "good-block": {**BASE, "sourceObject": BLOCK},
    "no-role": {**BASE, "sourceObject": {**BLOCK, "role": " "}}, "bad-role": {**BASE, "sourceObject": {**BLOCK, "role": "OWNER"}},
    "no-id": {**BASE, "sourceObject": {**BLOCK, "id": None}}, "bad-version": {**BASE, "sourceObject": {**BLOCK, "version": "soon"}},
    "bad-start": {**BASE, "sourceObject": {**BLOCK, "businessStart": "tomorrow"}},
    "other-time": {**BASE, "recordTimestamp": "2026-02-01T00:00:00Z", "sourceObject": BLOCK},
    "typed": {**BASE, "payload": {"phone": 41791234567, "email": True, "booking": {"email": "x@y.org"}, "idDocument": "P1"}},
    "document": {**BASE, "payload": {"idDocument": {"type": "PASSPORT"}, "firstName": "Anna", "birthdate": "1985"}},
}


def test_envelopes(spark):
    df = spark.createDataFrame([("t", n, name, json.dumps(b)) for n, (name, b) in enumerate(BODIES.items())], "tenant_id string, ordinal long, name string, body string")
    rows = {r.name: r for r in envelope.parse(df).collect()}
    assert rows["list"].error == "Each record must be a JSON object"
    for name, field in (("no-system", "sourceSystem"), ("blank-key", "externalKey"), ("number-key", "externalKey")):
        assert rows[name].error == f"Field '{field}' is required and must be a non-empty string"
    assert "payload" in rows["no-payload"].error and "recordTimestamp" in rows["bad-time"].error and "sourceObject" in rows["bad-block"].error
    fine = [n for n in BODIES if rows[n].error is None]
    assert fine == list(BODIES)[7:]
    assert [n for n in fine if rows[n].on_roster] == ["good-block", "bad-start", "other-time"]
    assert rows["good-block"].object_role == "BOOKER" and rows["good-block"].object_position == 2
    expected = {"no-role": "required", "bad-role": "not one of", "no-id": "type and id", "bad-version": "version", "bad-start": "businessStart", "other-time": "does not equal"}
    for name, part in expected.items():
        assert len(rows[name].object_reasons) == 1 and part in rows[name].object_reasons[0]
    parsed = envelope.parse(df).filter("error is null").withColumn("source_system", F.col("sourceSystem"))
    reasons = {r.name: r.reasons for r in extract(parsed).select("name", "reasons").collect()}
    assert reasons["typed"] == ["idDocument: expected an object with type and number", "no valid strong identifiers in record"]
    assert reasons["document"] == ["birthdate: not an ISO date", "idDocument: requires both type and number", "no valid strong identifiers in record"]


def test_payload_fields_keep_everything_but_documents(spark):
    body = {**BASE, "payload": {"email": " A@X.org", "vip": True, "idDocument": {"type": "P", "number": "1"}, "phone": "nonsense"}}
    df = spark.createDataFrame([("t", 1, json.dumps(body))], "tenant_id string, ordinal long, body string")
    records = extract(envelope.parse(df).withColumn("source_system", F.col("sourceSystem")))
    found = {r.field: r.value for r in envelope.profile_fields(records, "tenant_id").collect()}
    assert found == {"email": '"a@x.org"', "vip": "true", "phone": '"nonsense"'}


def test_tenant_relay_domains(spark):
    schema = "tenant_id string, source_system string, email string"
    df = spark.createDataFrame([("t", "pms", "a@relay.example"), ("u", "pms", "a@relay.example")], schema)
    domains = spark.createDataFrame([("t", "relay.example")], "tenant_id string, domain string")
    rows = {r.tenant_id: r for r in extract(df, domains).collect()}
    assert rows["t"].masked and rows["t"].email_identifier is None and rows["u"].email_identifier == "a@relay.example"
