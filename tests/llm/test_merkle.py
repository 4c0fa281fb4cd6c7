"""Manifest, proofs and tampering against a brute-force tree."""

import hashlib

import pytest
from pyspark.sql import functions as F

from kinfold.llm import merkle as M
from tests.llm.oracle import same_as_sql

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(nodes, fanout):
    """(root, siblings by leaf: one string per level)."""
    paths = [[] for _ in nodes]
    holders = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        upper, upper_holders = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            for k in range(len(run)):
                for leaf in holders[at + k]:
                    paths[leaf].append("".join(run[:k] + run[k + 1 :]))
            upper.append(h("".join(run)))
            upper_holders.append([x for part in holders[at : at + fanout] for x in part])
        nodes, holders = upper, upper_holders
    return nodes[0], paths


def brute(rows, fanout=3):
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append(row)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    parts = []
    for s in names:
        ordered = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        leaves = [brute_leaf(r) for r in ordered]
        parts.append((ordered, leaves, *brute_tree(leaves, fanout)))
    root, tops = brute_tree([p[2] for p in parts], fanout)
    out = []
    for (ordered, leaves, sub, paths), top in zip(parts, tops, strict=True):
        out += [(r[0], leaf, sub, root, "".join(p + top)) for r, leaf, p in zip(ordered, leaves, paths, strict=True)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def rows_of(n):
    return [
        (None if i % 31 == 0 else i // 2, None if i % 23 == 0 else ("hot" if i % 3 else f"s{i % 29}é"),
         None if i % 5 == 0 else "en", None if i % 6 == 0 else i, [None, "", "a\nb\n", "x" * (i % 50)][i % 4])
        for i in range(n)
    ]


@pytest.mark.parametrize("n,fanout", [(150, 3), (7, 2)])
def test_manifest(spark, n, fanout):
    rows = rows_of(n)
    found = M.manifest(frame(spark, rows), fanout=fanout)
    got = found.rows.select("row.*", F.col("leaf").alias("own"), "subroot", "path", M.proof(F.col("path")).alias("p"))
    got = got.withColumn("folded", M.fold(F.col("own"), F.col("path"))).collect()
    want = brute(rows, fanout)
    key = lambda t: tuple(x if x is not None else -1 for x in t)
    assert sorted(((r.doc_id, r.own, r.subroot, found.root, r.p) for r in got), key=key) == sorted(want, key=key)
    assert all(r.folded == found.root and r.leaf == r.tree == "clash" for r in got)
    assert not any(M_changed(r) for r in got)


def M_changed(row):
    """A changed leaf must not fold to the root."""
    node = h(row.own + "!")
    for at in row.path:
        node = h(at.before + node + at.after)
    return node == row.folded


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a", "en", 1, "t")] * 10 + [(1, "a", "en", 1, "u"), (2, None, None, None, None)]
    found = M.manifest(frame(spark, rows))
    got = found.rows.select("row.doc_id", F.col("leaf"), "subroot", M.proof(F.col("path"))).collect()
    assert sorted((r[0], r[1], r[2], found.root, r[3]) for r in got) == sorted(brute(rows))
    empty = M.manifest(frame(spark, []))
    assert empty.rows.count() == 0 and empty.root is None


def test_field_lengths_part_neighbours(spark):
    """No two rows put the same string together, whatever lies on which side of a border."""
    rows = [("ab", "c"), ("a", "bc"), ("-", None), (None, "-"), ("", "-"), ("é", ""), (None, None), ("1:-", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(M.leaf([F.col("a"), F.col("b")]).alias("h")).distinct().count() == len(rows)


def test_query(spark, sf_small):
    assert same_as_sql(spark, "op13_merkle_manifest", sf_small) > 0


def test_query_on_hard_rows(spark, tmp_path):
    frame(spark, rows_of(120)).drop("leaf", "tree").write.parquet(str(tmp_path / "documents.parquet"))
    assert same_as_sql(spark, "op13_merkle_manifest", tmp_path) == 120
    assert same_as_sql(spark, "op11_hilbert_sharding", tmp_path) == 120
