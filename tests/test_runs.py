"""Probes through merged runs against the whole history, and what a probe opens."""

import random
import tempfile

import pytest

from kinfold.sources import runs as R


def published(spark, root, generation, keys, placed, moves):
    folder = R.generation_folder(root, generation)
    spark.createDataFrame(keys, "tenant_id string, space string, rank int, type string, value string, record_no long").write.parquet(f"{folder}/keys")
    people = [("t", "s", f"k{r}", f"id{r}", r, False, "payload") for _, r, _, _ in placed]
    spark.createDataFrame(
        people, "tenant_id string, sourceSystem string, externalKey string, record_id string, record_no long, needs_review boolean, payload string"
    ).write.parquet(f"{folder}/records")
    spark.createDataFrame(placed, "tenant_id string, record_no long, guest_no long, generation long").write.parquet(f"{folder}/placed")
    spark.createDataFrame(moves, "absorbed long, survivor long").write.parquet(f"{folder}/moves")
    spark.createDataFrame([(generation, "stream", generation, generation * 10)], R.MARKER_SCHEMA).coalesce(1).write.parquet(f"{folder}/{R.MARKER}")


@pytest.fixture(scope="module")
def history(spark):
    """Five generations of random arrivals, merges and moves, with pairs merged into runs."""
    patch = pytest.MonkeyPatch()
    patch.setattr(R, "FAN", 2)
    patch.setattr(R, "BUCKETS", 3)
    rng = random.Random(4)
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    guest, parent, keys = {}, {}, []

    def top(g):
        while g in parent:
            g = parent[g]
        return g

    number, levels = 0, []
    for generation in range(5):
        placed, moves, mine = [], [], []
        for _ in range(6):
            number += 1
            alive = sorted({top(g) for g in guest.values()})
            guest[number] = number if not alive or rng.random() < 0.5 else rng.choice(alive)
            placed.append(("t", number, guest[number], generation))
            mine.append(("t", "I", 1, "EMAIL", f"e{rng.randrange(12)}", number))
        for _ in range(2):
            alive = sorted({top(g) for g in guest.values()})
            if len(alive) > 1:
                low, high = sorted(rng.sample(alive, 2))
                parent[high] = low
                moves.append((high, low))
        # A generation hands its own chains on in one step, as the store does.
        moves = [(a, top(a)) for a, _ in moves]
        if generation in (2, 4):
            record = rng.choice(sorted(guest))
            guest[record] = 1000 + generation
            placed.append(("t", record, guest[record], generation))
        keys += mine
        published(spark, root, generation, mine, placed, moves)
        R.compact(spark, root, R.generations(spark, root))
        levels.append([p.level for p in R.cover(spark, root, R.generations(spark, root))])
    yield root, keys, {r: top(g) for r, g in guest.items()}, guest, top, levels
    patch.undo()


def test_few_parts_however_long_the_history(history):
    assert history[5] == [[0], [1], [1, 0], [2], [2, 0]]


def test_probes_equal_the_whole(spark, history):
    root, keys, links, guest, top, _ = history
    parts = R.cover(spark, root, R.generations(spark, root))
    for asked in (["e1"], ["e2", "e5", "e9"], ["none"], [f"e{k}" for k in range(12)]):
        want = sorted(k for k in keys if k[4] in asked)
        df = spark.createDataFrame([("t", "I", "EMAIL", v) for v in asked], "tenant_id string, space string, type string, value string")
        assert sorted(map(tuple, R.probe(spark, parts, R.KEYS, df).collect())) == want
    some = spark.createDataFrame([(r,) for r in list(guest)[::5]], "record_no long")
    assert {r.record_no: r.guest_no for r in R.placements(spark, parts, some).collect()} == {r: guest[r] for r in list(guest)[::5]}
    every = spark.createDataFrame([(g,) for g in set(guest.values())], "guest_no long")
    assert {r.guest_no: r.survivor for r in R.survivors(spark, parts, every).collect()} == {g: top(g) for g in guest.values()}
    living = sorted(set(links.values()))[::2]
    found = R.members(spark, parts, spark.createDataFrame([(g,) for g in living], "guest_no long")).collect()
    assert sorted((r.record_no, r.guest_no) for r in found) == sorted((r, g) for r, g in links.items() if g in living)


def test_a_probe_opens_its_buckets_only(spark, history):
    root = history[0]
    run = [p for p in R.cover(spark, root, R.generations(spark, root)) if p.level == 2]
    one = spark.createDataFrame([(7,)], "record_no long")
    plan = R.probe(spark, run, R.BY_RECORD, one)._jdf.queryExecution().executedPlan().toString()
    number = one.select(R._bucket(R.BY_RECORD)).first()[0]
    assert "PartitionFilters: [" in plan and f"(bucket#" in plan and f"= {number})" in plan


def test_markers_and_torn_runs(spark, history):
    root, *_ = history
    known = R.generations(spark, root)
    parts = R.cover(spark, root, known)
    rows = R.markers(spark, parts).collect()
    assert sorted((r.generation, r.epoch, r.top) for r in rows) == [(g, g, 10 * g) for g in known]
    # A run that stands for other generations than the published ones is not used.
    assert [p.level for p in R.cover(spark, root, [g for g in known if g != 3])] == [1, 0, 0]
