"""The curve itself, exact cuts, shard files with ranges, and the query against SQL."""

import itertools

import pytest
from pyspark.sql import functions as F

from kinfold.llm import hilbert as H
from tests.llm.oracle import same_as_sql

SCHEMA = "doc_id long, source string, lang string, n_chars long, shard string, curve string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


@pytest.mark.parametrize("axes,bits", [(2, 1), (2, 3), (3, 3), (4, 2)])
def test_curve_visits_every_cell_and_steps_to_a_neighbour(spark, axes, bits):
    names = [f"x{i}" for i in range(axes)]
    cells = list(itertools.product(range(2**bits), repeat=axes))
    df = spark.createDataFrame(cells, ", ".join(f"{n} int" for n in names))
    kept = df.select("*", *(F.col(n).alias(f"k{n}") for n in names))
    rows = H.with_curve(kept, names, bits, "h").orderBy("h").collect()
    assert [r.h for r in rows] == list(range(len(cells)))
    points = [tuple(r[f"k{n}"] for n in names) for r in rows]
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(points, points[1:]))


def rows_of(n):
    """A third of the rows share one source, ids repeat, every column has nulls."""
    return [
        (None if i % 17 == 0 else i // 2, None if i % 11 == 0 else ("hot" if i % 3 else f"s{i % 13}"),
         [None, "en", "de", "fr"][i % 4], None if i % 7 == 0 else i * i % 997)
        for i in range(n)
    ]


def test_cells_are_shares_of_smaller_rows(spark):
    rows = rows_of(500)
    df = frame(spark, rows)
    key = lambda v: (v is not None, v if v is not None else "")
    for name, at in (("source", 1), ("lang", 2), ("n_chars", 3)):
        values = [r[at] for r in rows]
        want = {v: sum(key(w) < key(v) for w in values) * 16 // len(values) for v in set(values)}
        cell = H.cell_of(F.col(name), H.bounds(df, name, 4))
        assert {r[0]: r[1] for r in df.select(name, cell).distinct().collect()} == want


@pytest.mark.parametrize("n,shards", [(500, 24), (5, 24), (48, 24), (1, 3)])
def test_shards_are_even_and_gapless(spark, n, shards):
    got = H.shard(frame(spark, rows_of(n)), shards=shards).collect()
    assert len(got) == n
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append((r.slot, r.curve, r.row.doc_id is not None, r.row.doc_id or 0))
        assert r.row.shard == r.row.curve == "clash"
    assert all(sorted(s for s, *_ in v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    order = [x[1:] for k in sorted(by) for x in sorted(by[k])]
    assert order == sorted(order)


def test_empty_and_repeated_rows(spark):
    assert H.shard(frame(spark, [])).count() == 0
    same = H.shard(frame(spark, [(1, "a", "en", 5)] * 50), shards=4).collect()
    assert sorted((r.shard, r.slot) for r in same) == [(k, s) for k in range(4) for s in range(12 + (k % 2 == 0))]


def test_files_are_pruned_by_every_dimension(spark, tmp_path):
    rows = [(i, f"s{i % 16:02}", f"l{i // 16 % 16:02}", i * 7919 % 1000) for i in range(4096)]
    df = frame(spark, rows)
    H.write_shards(H.shard(df), str(tmp_path / "x"))
    ranges = spark.read.parquet(str(tmp_path / "x" / "ranges"))
    assert ranges.agg(F.sum("rows")).first()[0] == len(rows)
    asks = [{"source": ("s03", "s03")}, {"lang": ("l02", "l03")}, {"n_chars": (0, 60)},
            {"source": ("s01", "s02"), "n_chars": (900, 1000)}, {"source": ("zz", "zz")}]
    for within in asks:
        got = {r.row.doc_id for r in H.read_shards(spark, str(tmp_path / "x"), within).collect()}
        at = {"source": 1, "lang": 2, "n_chars": 3}
        assert got == {r[0] for r in rows if all(lo <= r[at[d]] <= hi for d, (lo, hi) in within.items())}
    for i, (low, high) in enumerate([("s03", "s03"), ("l02", "l02"), (0, 60)]):
        hit = ranges.filter((F.col(f"least{i}") <= F.lit(high)) & (F.col(f"greatest{i}") >= F.lit(low))).count()
        assert hit <= 16


def test_query(spark, sf_small):
    assert same_as_sql(spark, "op11_hilbert_sharding", sf_small) > 0
