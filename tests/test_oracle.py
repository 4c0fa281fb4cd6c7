"""Registered queries beside their SQL, on whole small tables."""

import datetime

import duckdb
import pytest

import __spark_entry__ as contract
from kinfold.plans import oracle_sql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# Quick enough to compare in every run; the driver compares them all.
SHOWN = [
    "identifiers_extracted", "needs_review_reasons", "observation_dedup", "identifier_effects", "guest_clusters",
    "golden_profile", "guest_view", "fuzzy_scores", "timeline_ended", "timeline_page", "object_view", "config_as_of",
    "review_page", "unmerge_rules", "block_keys", "guest_profiles", "unmerge_applied", "review_decisions_applied", "rule_lift", "decision_errors",
]


def plain(value):
    return value.replace(tzinfo=None).isoformat() if isinstance(value, datetime.datetime) else value


@pytest.fixture(scope="module")
def engine(sf_small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{sf_small}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", SHOWN)
def test_same_rows(spark, engine, sf_small, name):
    mine = contract.queries()[name](spark, sf_small)
    theirs = engine.sql(contract.oracle_sql()[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    columns = sorted(mine.columns)
    got = sorted(str(tuple(plain(r[c]) for c in columns)) for r in mine.collect())
    places = [theirs.columns.index(c) for c in columns]
    expected = sorted(str(tuple(plain(r[p]) for p in places)) for r in theirs.fetchall())
    assert got == expected


def test_phonetic_codes_are_the_library_s(spark):
    """The codes that the SQL twins take as fixed values, against the library that Spark ships."""
    coder = spark._jvm.org.apache.commons.codec.language.DoubleMetaphone()
    pairs = [pair.split("=") for pair in oracle_sql.PHONETIC_CODES.split()]
    assert len(pairs) == 82 and all(coder.doubleMetaphone(name) == code for name, code in pairs)


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
