"""Merkle manifest of a dataset: one tree per source, one over the sources.

A level is built by a slot pivot: nodes are grouped by parent and conditional aggregates spread the
children of each parent into as many columns as the fanout; the parent's digest is that of the
columns put together. On the way back, a node's siblings are its parent's columns without its own
slot. Every level is a grouping and a join on (tree, place), so a source with a third of all rows
is dealt out like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from kinfold.llm.ranks import ranked
from kinfold.session import cut

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """``-`` for null, else the value's length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    )


def leaf(values: list[Column]) -> Column:
    """Digest of a row's fields; no two different rows put the same string together."""
    return digest(F.concat(*map(field, values)))


def fold(node: Column, path: Column) -> Column:
    """Root that a leaf's digest and its siblings, from the leaf upwards, lead to."""
    return F.aggregate(path, node, lambda below, at: digest(F.concat(at["before"], below, at["after"])))


def proof(path: Column) -> Column:
    """All siblings put together, level by level from the leaf, left to right."""
    return F.array_join(F.transform(path, lambda at: F.concat(at["before"], at["after"])), "")


def _grow(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels above ``nodes`` (tree, place, total, node), lowest first, and each tree's last node."""
    levels, tops = [], nodes.filter("total = 1").select("tree", "node")
    left = nodes.agg(F.max("total")).first()[0] or 1
    while left > 1:
        parent = F.floor(F.col("place") / fanout).alias("place")
        slots = [F.max(F.when(F.col("place") % fanout == s, F.col("node"))).alias(f"slot{s}") for s in range(fanout)]
        pivot = nodes.filter("total > 1").groupBy("tree", parent).agg(
            *slots, F.ceil(F.max("total") / fanout).alias("total")
        )
        pivot = cut(pivot.withColumn("node", digest(F.concat_ws("", *(f"slot{s}" for s in range(fanout))))))
        levels.append(pivot)
        nodes = pivot.select("tree", "place", "total", "node")
        tops = tops.unionByName(nodes.filter("total = 1").select("tree", "node"))
        left = -(-left // fanout)
    return levels, tops


def _descend(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` with ``path`` and ``top``; ``tops`` (tree, top, path) is what lies above each tree."""
    above = None
    for depth in range(len(levels), -1, -1):
        here = levels[depth - 1] if depth else nodes
        reached = here.filter("total = 1").join(tops, "tree")
        if above is not None:
            slots = [F.col(f"slot{s}").alias(f"upper{s}") for s in range(fanout)]
            upper = above.select("tree", F.col("place").alias("parent"), *slots, F.col("path").alias("rest"), "top")
            parent = F.floor(F.col("place") / fanout)
            under = here.filter("total > 1").withColumn("parent", parent).join(upper, ["tree", "parent"])
            path = F.concat(F.array(_siblings(fanout)), F.col("rest"))
            reached = reached.unionByName(under.withColumn("path", path).select(*here.columns, "top", "path"))
        # A plan over many levels weighs on the driver; upper levels are small, so a cut is cheap there.
        above = cut(reached) if depth > 1 and depth % 3 == 2 else reached
    return above


def _siblings(fanout: int) -> Column:
    """The parent's columns without the node's own slot."""
    own = F.col("place") % fanout
    before = [F.when(own > s, F.col(f"upper{s}")) for s in range(fanout)]
    after = [F.when(own < s, F.col(f"upper{s}")) for s in range(fanout)]
    return F.struct(F.concat_ws("", *before).alias("before"), F.concat_ws("", *after).alias("after"))


@dataclass
class Manifest:
    """``rows`` is (row, leaf, subroot, path): each input row, its leaf, its source's root, and the
    siblings (before, after) of every level from the leaf to the root. ``root`` is null for an empty
    table."""

    rows: DataFrame
    root: str | None


def manifest(
    docs: DataFrame,
    leaf_of: Column | None = None,
    source: str = "source",
    doc_id: str = "doc_id",
    fanout: int = FANOUT,
) -> Manifest:
    """Merkle manifest of ``docs``.

    Leaves of a source stand by ``doc_id``, null first, rows that share one by leaf; equal rows are
    interchangeable. Sources stand by UTF-8 bytes, null first. While several nodes remain, every
    ``fanout`` consecutive ones, the last run fewer, become their digest; a lone leaf is its
    source's root. ``leaf_of`` defaults to the digest of ``FIELDS``. Input columns of any name are
    safe inside ``row``, which travels through the sort: leave out what is not asked for.
    """
    leaf_of = leaf([F.col(c) for c in FIELDS]) if leaf_of is None else leaf_of
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(source).alias("source"), F.col(doc_id).alias("id"),
        leaf_of.alias("node"),
    )
    placed = ranked(rows, ["source"], [F.col("id").asc_nulls_first(), F.col("node")])
    leaves = placed.select("row", F.col("first").alias("tree"), F.col("rank").alias("place"), "total", "node")
    levels, roots = _grow(leaves, fanout)
    subroots = cut(ranked(cut(roots), [], [F.col("tree")]))
    upper = subroots.select(
        F.col("tree").alias("of"), F.lit(0).cast("long").alias("tree"), F.col("rank").alias("place"), "total", "node"
    )
    upper_levels, top = _grow(upper, fanout)
    root = top.first()
    over = top.select("tree", F.col("node").alias("top"), F.array().cast(PATH).alias("path"))
    sources = cut(
        _descend(upper, upper_levels, over, fanout)
        .select(F.col("of").alias("tree"), F.col("node").alias("top"), "path")
    )
    found = _descend(leaves, levels, sources, fanout)
    return Manifest(
        found.select("row", F.col("node").alias("leaf"), F.col("top").alias("subroot"), "path"),
        root.node if root else None,
    )
