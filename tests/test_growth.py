"""Work that a query does once only, however large its tables are."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from kinfold.functions import text as X
from kinfold.operators import components, scoring, survivorship
from kinfold.plans import catalog
from kinfold.session import cut
from kinfold.sources import feeds


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_envelopes_are_parsed_once(spark, sf_small):
    plan = optimized(contract.queries()["object_identity_reasons"](spark, sf_small))
    assert plan.count("parseJson") == 1


def blocks(spark, folder):
    records = catalog._numbered(spark, folder)
    linked = records.join(catalog._links(records).select("record_no", "guest_no"), "record_no")
    return [cut(part) for part in scoring.sides(linked)]


def test_pairs_of_a_block_are_not_dealt_out_again(spark, sf_small):
    plan = optimized(scoring.candidate_pairs(*blocks(spark, sf_small)))
    above = plan[: plan.index("Join Inner")]
    assert "Aggregate" not in above and "Join LeftAnti" not in above


def test_pairs_are_scored_where_they_meet(spark, sf_small):
    """Rows are sent to their blocks; no pair's texts are sent anywhere to be compared."""
    looks, holders, members = blocks(spark, sf_small)
    plan = optimized(scoring.score_pairs(scoring.candidate_pairs(looks, holders, members), looks, holders))
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 1
    assert "Join" not in plan[: plan.index("MapInArrow")]


def test_signals_are_those_of_the_facts(spark, sf_small):
    """Pairs without their signals get the same scores from the facts of both sides."""
    looks, holders, members = blocks(spark, sf_small)
    pairs = cut(scoring.candidate_pairs(looks, holders, members))
    bare = pairs.select("tenant_id", "look", "holder", "rank")
    scored = sorted(scoring.score_pairs(pairs, looks, holders).collect(), key=str)
    assert scored and sorted(scoring.score_pairs(bare, looks, holders).collect(), key=str) == scored


def test_holders_with_many_entries_meet_the_same_pairs(spark, sf_small, monkeypatch):
    sides = blocks(spark, sf_small)
    columns = ["tenant_id", "look", "holder", "rank"]
    carried = sorted(scoring.candidate_pairs(*sides).select(*columns).collect())
    monkeypatch.setattr(scoring, "CARRIED_ENTRIES", 5)
    monkeypatch.setattr(scoring, "BLOCK_PIECE", 1)
    assert carried and sorted(scoring.candidate_pairs(*sides).select(*columns).collect()) == carried


def test_texts_are_not_sorted_to_number_orders(spark, sf_small, monkeypatch):
    """Arrival numbers are drawn for the columns that the texts are made of."""
    sorted_columns = []
    plain = feeds.number_records

    def number_records(records, *order):
        sorted_columns.append(records.columns)
        return plain(records, *order)

    monkeypatch.setattr(feeds, "number_records", number_records)
    records = catalog._numbered(spark, sf_small, [])
    assert sorted_columns == [["o_orderkey", "o_custkey", "o_orderdate"]]
    assert records.columns == ["tenant_id", "record_no", "ord", *catalog.IDENTIFIER_COLUMNS]


def test_a_profile_reads_its_rows_once(spark, sf_small):
    records = catalog._numbered(spark, sf_small, catalog.PROFILE_COLUMNS)
    linked = records.withColumn("guest_no", F.col("record_no"))
    fields = survivorship.field_rows(linked, "tenant_id", "guest_no", "record_no", "effective_at", "received_at")
    plan = optimized(survivorship.golden_profile(fields))
    assert plan.count("Relation [") == 1 and "Union" not in plan


@pytest.mark.parametrize("value", ['"a\\u0020"', '" "', '"\\t"', '" "', '"7"', '"é"', '"', '"a"b"', '"\\"a"', '""', "7", '"a\n"'])
def test_plain_texts_are_told_as_parsing_tells_them(spark, value):
    """A text that need not be parsed is one that parsing finds to be whole and not blank."""
    one = spark.createDataFrame([(value,)], "value string").select(
        F.col("value").rlike(survivorship.PLAIN_TEXT_PATTERN).alias("plain"),
        F.try_variant_get(F.try_parse_json("value"), "$", "string").rlike(X.NOT_BLANK_PATTERN).alias("said"),
    ).first()
    assert one.said if one.plain else True
    assert one.plain == (value in ('"7"',))


def test_leaves_stay_out_of_the_rounds(spark, monkeypatch):
    """Ten thousand records that carry two identifiers of a hundred holders make a round of holders only."""
    rows = [(1000 + n, n % 100) for n in range(10_000)] + [(1000 + n, (n % 100) // 10 * 10) for n in range(10_000)]
    seen = []
    plain = components._unsettled

    def unsettled(edges):
        seen.append(edges.count())
        return plain(edges)

    monkeypatch.setattr(components, "_unsettled", unsettled)
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert seen and max(seen) <= 100
    assert len(found) == 10_100 and all(root == (node % 100) // 10 * 10 for node, root in found.items())
