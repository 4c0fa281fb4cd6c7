"""Small person feeds: each scenario is its own tenant, so one run resolves all of them."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from kinfold.operators.order import number_records
from kinfold.plans.resolve import prepare
from kinfold.sources.extract import extract

BASE = datetime(2026, 7, 9, 10, 0, 0)
FIELDS = [
    "firstName", "lastName", "birthdate", "email", "phone", "loyaltyId", "externalGuestId",
    "doc_type", "doc_number", "doc_shape", "city",
]
SCHEMA = (
    "tenant_id string, source_system string, external_key string, record_timestamp timestamp, "
    "received_at timestamp, " + ", ".join(f"{f} string" for f in FIELDS)
)


def rows(tenant, records, start=0):
    """records: {name: {field: value}} in call order."""
    made = []
    for n, (name, fields) in enumerate(records.items()):
        at = BASE + timedelta(seconds=start + n)
        made.append((tenant, "pms", name, None, at, *[fields.get(f) for f in FIELDS]))
    return made


def frame(spark, made, config=None, rules=None, start=0):
    from kinfold.operators.rules import masked_domains

    df = spark.createDataFrame(made, SCHEMA)
    domains = masked_domains(rules) if rules is not None else None
    df = number_records(extract(df, domains), "received_at", "external_key", start=start)
    return prepare(df, config)


def clusters(links, records):
    """{tenant: set of frozensets of names}"""
    names = records.select("tenant_id", "record_no", "external_key")
    grouped = (
        links.drop("tenant_id").join(names, "record_no").groupBy("tenant_id", "guest_no")
        .agg(F.collect_set("external_key").alias("names")).collect()
    )
    out = {}
    for row in grouped:
        out.setdefault(row.tenant_id, set()).add(frozenset(row.names))
    return out


def groups(*sets):
    return {frozenset(s) for s in sets}
