"""Survivorship cases and object observations in, profiles and associations out."""

from datetime import datetime

from pyspark.sql import functions as F

from kinfold.operators.survivorship import golden_profile, matching_profile, payload_field_rows
from kinfold.operators.timeline import associations, object_view, timeline_pages

JAN, MAR, JUN = datetime(2026, 1, 1), datetime(2026, 3, 1), datetime(2026, 6, 1)
CASES = {
    "recent": [('{"firstName":"Anna","email":"old@example.com"}', JAN, JAN), ('{"email":"new@example.com"}', JUN, JUN)],
    "blank": [('{"firstName":"Anna","lastName":"Muster"}', JAN, JAN), ('{"firstName":null,"lastName":"  "}', JUN, JUN)],
    "fallback": [('{"firstName":"Old"}', MAR, MAR), ('{"firstName":"New"}', None, JUN)],
    "conflict": [('{"email":"one@example.com","phone":"+41790000001"}', JAN, JAN), ('{"email":"two@example.com"}', MAR, MAR),
                 ('{"email":"three@example.com","firstName":"Anna"}', JUN, JUN)],
    "masked": [('{"email":"anna@example.com"}', JAN, JAN), ('{"email":"x1@guest.booking.com","emailMasked":true}', JUN, JUN)],
    "only-masked": [('{"email":"x1@guest.booking.com","emailMasked":true}', JUN, JUN)],
    "typed": [('{"vip":true,"nights":3,"nested":{"a":1}}', JAN, JAN), ('{"nights":4}', JUN, JUN)],
}
EXPECTED = {
    "recent": {"firstName": '"Anna"', "email": '"new@example.com"'},
    "blank": {"firstName": '"Anna"', "lastName": '"Muster"'},
    "fallback": {"firstName": '"New"'},
    "conflict": {"email": '"three@example.com"', "phone": '"+41790000001"', "firstName": '"Anna"'},
    "masked": {"email": '"anna@example.com"'},
    "only-masked": {"email": '"x1@guest.booking.com"', "emailMasked": "true"},
    "typed": {"vip": "true", "nights": "4", "nested": '{"a":1}'},
}


def test_golden_profiles(spark):
    made, n = [], 0
    for tenant, records in CASES.items():
        for body, stamp, received in reversed(records):
            made.append((tenant, 0, n, body, stamp or received, received))
            n += 1
    df = spark.createDataFrame(made, "tenant_id string, guest_no long, record_no long, extracted string, effective_at timestamp, received_at timestamp")
    rows = payload_field_rows(df, "extracted", "tenant_id", "guest_no", "record_no", "effective_at", "received_at")
    found = {}
    for r in golden_profile(rows).collect():
        found.setdefault(r.tenant_id, {})[r.field] = r.value
    assert found == EXPECTED


def test_matching_profile_prefers_a_real_email(spark):
    schema = "tenant_id string, guest_no long, record_no long, effective_at timestamp, received_at timestamp, email_masked boolean, firstName string, lastName string, birth_iso string, phone_kept string, email_kept string, city string"
    df = spark.createDataFrame([
        ("t", 0, 0, JAN, JAN, False, "Anna", None, None, None, "a@example.com", None),
        ("t", 0, 1, JUN, JUN, True, " ", "Muster", None, None, "x@guest.booking.com", None)], schema)
    row = matching_profile(df).first()
    assert (row.firstName, row.lastName, row.real_email) == ("Anna", "Muster", "a@example.com")


V1, V2, V3 = JAN, MAR, JUN
P, A, B = "PRIMARY_GUEST", "ADDITIONAL_GUEST", "BOOKER"
OBSERVED = {
    "three-versions": [("R1", P, None, V1, "anna"), ("R1", P, None, V2, "anna"), ("R1", P, None, V3, "anna")],
    "two-roles": [("R1", P, None, V1, "anna"), ("R1", A, 0, V1, "bruno")],
    "twice": [("R1", A, 0, V1, "anna"), ("R1", A, 1, V1, "anna")],
    "reassigned": [("R1", P, None, V1, "anna"), ("R1", P, None, V2, "bruno")],
    "dropped": [("R2", A, 0, V1, "yara"), ("R2", A, 1, V1, "zoe"), ("R2", A, 0, V2, "zoe")],
    "emptied": [("R2", P, None, V1, "anna"), ("R2", A, 0, V1, "yara"), ("R2", P, None, V2, "anna")],
    "late": [("R1", P, None, V3, "bruno"), ("R1", P, None, V2, "anna")],
    "reverted": [("R1", P, None, V1, "anna"), ("R1", P, None, V2, "bruno"), ("R1", P, None, V3, "anna")],
    "booker": [("R1", P, None, V1, "anna"), ("R1", B, None, V1, "anna")],
    "partial": [("R3", P, None, V1, "anna"), ("R3", A, 0, V1, "yara"), ("R3", P, None, V2, "anna")],
}
SEEN = {
    "three-versions": {("anna", P, "CURRENT", None, 3)},
    "two-roles": {("anna", P, "CURRENT", None, 1), ("bruno", A, "CURRENT", None, 1)},
    "twice": {("anna", A, "CURRENT", None, 2)},
    "reassigned": {("anna", P, "ENDED", "bruno", 2), ("bruno", P, "CURRENT", None, 2)},
    "dropped": {("yara", A, "ENDED", None, 3), ("zoe", A, "CURRENT", None, 3)},
    "emptied": {("anna", P, "CURRENT", None, 2), ("yara", A, "ENDED", None, 1)},
    "late": {("anna", P, "ENDED", "bruno", 2), ("bruno", P, "CURRENT", None, 2)},
    "reverted": {("anna", P, "CURRENT", None, 3), ("bruno", P, "ENDED", "anna", 3)},
    "booker": {("anna", P, "CURRENT", None, 1), ("anna", B, "CURRENT", None, 1)},
    "partial": {("anna", P, "CURRENT", None, 2), ("yara", A, "ENDED", None, 1)},
}
OBS = "tenant_id string, source_system string, object_type string, object_id string, object_role string, object_position int, object_version timestamp, business_start timestamp, business_end timestamp, guest_id string, record_id long, effective_ts timestamp"


def observe(spark, cases):
    made = [
        (t, r[5] if len(r) > 5 else "opera", "reservation", r[0], r[1], r[2], r[3], r[6] if len(r) > 6 else None, None, r[4], n, r[3])
        for t, rows in cases.items() for n, r in enumerate(rows)
    ]
    return spark.createDataFrame(made, OBS)


def test_associations(spark):
    found = {}
    for r in associations(observe(spark, OBSERVED)).collect():
        found.setdefault(r.tenant_id, set()).add((r.guest_id, r.object_role, r.status, r.successor_guest_id, r.observation_count))
    assert found == SEEN


def test_timeline_order_and_pages(spark):
    cases = {
        "by-start": [("OLD", P, None, V3, "anna", "opera", datetime(2025, 6, 1)), ("NEW", P, None, V1, "anna", "opera", datetime(2026, 9, 1))],
        "fallback": [("DATED", P, None, V1, "anna", "opera", datetime(2026, 5, 1)), ("UNDATED", P, None, V1, "anna")],
        "ties": [("B", P, None, V1, "anna"), ("A", P, None, V1, "anna"), ("A", P, None, V1, "anna", "channel")],
    }
    everything = associations(observe(spark, cases))
    shown = {}
    for r in timeline_pages(everything, 50).orderBy("tenant_id", "place").collect():
        shown.setdefault(r.tenant_id, []).append((r.source_system, r.object_id))
    assert [o for _, o in shown["by-start"]] == ["OLD", "NEW"]
    assert [o for _, o in shown["fallback"]] == ["UNDATED", "DATED"]
    assert shown["ties"] == [("channel", "A"), ("opera", "A"), ("opera", "B")]
    walked, after = [], None
    ties = everything.filter("tenant_id = 'ties'")
    while True:
        page = timeline_pages(ties, 1, after).collect()
        if not page:
            break
        walked.append((page[0].source_system, page[0].object_id))
        after = (page[0].ordering_time, page[0].ordering_key)
    assert walked == shown["ties"]


def test_object_view(spark):
    view = object_view(observe(spark, {"dropped": OBSERVED["dropped"]}))
    rows = view.orderBy("object_version", "record_id").collect()
    assert [r.on_roster for r in rows] == [False, False, True] and {r.current_version for r in rows} == {V2}
