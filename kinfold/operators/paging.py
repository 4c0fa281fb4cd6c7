"""Keyset pages: filter past a position, then a top-k that never sorts the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


MOST_ROWS = 200


def check_limit(limit: int) -> None:
    """A page has 1 to ``MOST_ROWS`` rows; other wishes are refused, not cut."""
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"a page has 1 to {MOST_ROWS} rows, not {limit}")


def page(
    rows: DataFrame, time: str, key: str, limit: int, after: tuple | None = None,
    descending: bool = False,
) -> DataFrame:
    """Up to ``limit`` rows after the (time, key) position, and one more to tell if a page follows."""
    check_limit(limit)
    t, k = F.col(time), F.col(key)
    if after is not None:
        at, last = F.lit(after[0]), F.lit(after[1])
        past = (t < at) | ((t == at) & (k < last)) if descending else (t > at) | ((t == at) & (k > last))
        rows = rows.filter(past)
    order = [t.desc(), k.desc()] if descending else [t.asc(), k.asc()]
    return rows.orderBy(*order).limit(limit + 1)


def review_page(
    reviews: DataFrame, status: str = "PENDING", limit: int = 50, after: tuple | None = None
) -> DataFrame:
    return page(reviews.filter(F.col("status") == status), "created_at", "review_id", limit, after)


def rule_page(
    rules: DataFrame, include_lifted: bool = False, limit: int = 50, after: tuple | None = None
) -> DataFrame:
    shown = rules if include_lifted else rules.filter("lifted_at is null")
    return page(shown, "created_at", "rule_id", limit, after, descending=True)


def rule_counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("all_rules"),
        F.count(F.when(F.col("lifted_at").isNull(), 1)).alias("active_rules"),
    )
