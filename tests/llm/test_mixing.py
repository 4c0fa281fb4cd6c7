"""Source targets, curriculum positions, and the mix as rows."""

import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinfold.llm import mixing as M
from kinfold.llm.queries import op2_mixing
from tests.llm.oracle import same_as_sql

SCHEMA = "doc_id long, text string, source string, _size string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash") for i, t, s in rows], SCHEMA).drop("_size")


def brute_targets(sizes, weights, most):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return full | share
        full |= {s: float(most * sizes[s]) for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 500, None: 3},
    {"a": 1, "b": 1, "c": 1, "d": 10_000, "é": 20, "Z": 0},
    {"only": 7}, {"a": 0, "b": 0}, {None: 5, "": 50},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in M.source_targets(df).collect()}
    want = brute_targets(sizes, M.WEIGHTS, 3)
    assert set(got) == set(want)
    assert all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in want)
    assert math.isclose(sum(got.values()), sum(sizes.values()), abs_tol=1e-6)


def test_positions_invert_the_area(spark):
    shares = [i / 200 for i in range(201)]
    for turn, curve in enumerate(M.CURVES):
        df = spark.createDataFrame([(x,) for x in shares], "x double")
        got = [r[0] for r in df.select(M.position(F.col("x"), F.lit(turn)).alias("p")).collect()]
        assert got == sorted(got) and got[0] == 0 and math.isclose(got[-1], 1)
        for share, at in zip(shares, got, strict=True):
            steps = 4000
            knots = len(curve) - 1
            area = sum(
                curve[min(int(u * knots), knots - 1)]
                + (curve[min(int(u * knots), knots - 1) + 1] - curve[min(int(u * knots), knots - 1)])
                * (u * knots - min(int(u * knots), knots - 1))
                for u in ((k + 0.5) / steps * at for k in range(steps))
            ) * at / steps
            whole = sum((a + b) / 2 for a, b in zip(curve, curve[1:])) / knots
            assert math.isclose(area, share * whole, abs_tol=2e-3)


def test_mix_rows(spark):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 3}") for i in range(300)]
    rows += [(None, None, None), (5, "x y", "tiny"), (5, "x y", "tiny"), (6, "", "empty")]
    docs = frame(spark, rows)
    mixed = M.mix(docs).collect()
    assert {f for f in mixed[0].__fields__} == {"doc_id", "text", "source", "position"}
    assert [r.position for r in mixed] == sorted(r.position for r in mixed)
    taken = defaultdict(int)
    for r in mixed:
        taken[r.source] += len((r.text or "").split())
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(dict(sizes), M.WEIGHTS, 3)
    assert all(abs(taken[s] - want[s]) <= 7 for s in want)
    assert sorted(M.mix(docs).collect()) == sorted(mixed)
    # "tiny" is at its bound: each of the repeated rows is taken three times.
    assert sum(r.source == "tiny" for r in mixed) == 6


def test_empty_table(spark):
    assert M.mix(frame(spark, [])).count() == 0
    assert M.assign(frame(spark, [])).count() == 0


def test_query(spark, sf_small):
    assert same_as_sql(spark, "op2_mixing", sf_small) > 0


def test_query_comes_from_the_placed_mix(spark, sf_small):
    """Rows stand in training order, and each document's words are those of its copies in the mix."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    first, taken = {}, defaultdict(int)
    for r in M.mix(docs).collect():
        first[r.doc_id] = min(first.get(r.doc_id, 1.0), r.position)
        taken[r.doc_id] += len(re.findall(M.WORD, r.text or ""))
    rows = op2_mixing(spark, sf_small).collect()
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: taken[r.doc_id] for r in rows}
    places = [first.get(r.doc_id, 2.0) for r in rows]
    assert places == sorted(places) and places[0] < places[-1]


def test_whole_rows_are_shuffled_once_before_the_range_sort(spark):
    docs = frame(spark, [(i, "x " * i, "ab"[i % 2]) for i in range(20)] + [(30, "n", None)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = M.assign(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    window = next(n for n, line in enumerate(lines) if "Window [sum(_size" in line)
    join = next(n for n, line in enumerate(lines) if n > window and "SortMergeJoin" in line)
    assert not any("Exchange" in line for line in lines[window:join])


def test_slices_of_null_and_odd_sources_stay_apart(spark):
    docs = frame(spark, [(i, "w", s) for i, s in enumerate([None, "", "=", ":", "null"] * 4)])
    rows = M.assign(docs).collect()
    assert len(rows) == 20
    for source in (None, "", "=", ":", "null"):
        places = sorted(r["_place"] for r in rows if r["source"] == source)
        assert places == [0.5, 1.5, 2.5, 3.5]
