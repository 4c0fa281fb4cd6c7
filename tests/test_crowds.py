"""Reviews of crowded identifiers counted as they are when written as pairs."""

import random
from collections import Counter

import pytest

from kinfold.operators import crowds, decisions as D
from kinfold.plans import decision_queries
from tests.test_waves import LIMIT, asked, world_from


@pytest.mark.parametrize("seed", [3, 4])
def test_cases_count_the_pairs(spark, seed):
    """Records of guests by threes carry up to three crowded identifiers; some decisions take two or
    all records out, so guests empty, and one pair is pending before."""
    rng = random.Random(seed)
    carried = {r: [f"e{r // 3}"] + [f"crowd{k}" for k in range(3) if rng.random() < 0.4] for r in range(60)}
    guest = {r: r - r % 3 for r in carried}
    made = [
        ("UNMERGE", (g, rng.sample([g, g + 1, g + 2], rng.choice([1, 1, 2, 3])))) for g in range(0, 60, 3) if rng.random() < 0.8
    ]
    reviews = [("r0", made[-1][1][1][0], 0)]
    world = world_from(spark, carried, guest, reviews, LIMIT)
    pairs, _, _ = D.apply_decisions(world, asked(spark, made))
    after, _, _ = D.apply_decisions(world, asked(spark, made), as_cases=True)
    expected = Counter(r.record_no for r in pairs.reviews.collect())
    found = Counter(r.record_no for r in after.reviews.collect())
    assert sum(found.values()) <= 1
    for row in after.cases.collect():
        found[row.record_no] += row.candidates
    assert found == expected and sum(expected.values()) > 100


def test_unmerged_orders_form_no_pairs(spark, sf_small, monkeypatch):
    """The query counts its reviews: no row of the queue is written for a crowded identifier."""
    seen = []
    plain = decision_queries.apply_decisions

    def apply_decisions(*given, **more):
        seen.append(plain(*given, **more))
        return seen[-1]

    monkeypatch.setattr(decision_queries, "apply_decisions", apply_decisions)
    from kinfold.plans import catalog

    total = catalog.QUERIES["unmerge_applied"](spark, sf_small).agg({"reviews": "sum"}).first()[0]
    assert total > 0 and seen[0][0].reviews.count() == 0
