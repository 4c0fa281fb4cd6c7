"""Many decisions at once equal decisions one by one, in as many waves as they depend on each other."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kinfold.operators import decisions as D
from kinfold.operators.separations import RULE_SCHEMA, SIDE_SCHEMA, rule_pairs
from tests.test_decisions import DECISION

T0 = datetime(2026, 1, 1)
PERSON = (
    "tenant_id string, record_no long, first_fold string, last_fold string, "
    "effective_at timestamp, received_at timestamp"
)


LIMIT = 4


def world_from(spark, carried, guest, reviews, limit=10):
    """``carried`` {record: identifiers}, ``guest`` {record: guest}, ``reviews`` [(id, record, candidate)]."""
    people = [("t", r, None, None, T0, T0) for r in carried]
    ids = [("t", 1, "EMAIL", v, r, False) for r, vs in carried.items() for v in vs]
    queue = [("t", i, r, c, "EMAIL", "x", "why", "m", None, "PENDING", None, None) for i, r, c in reviews]
    return D.World(
        spark.createDataFrame(people, PERSON),
        spark.createDataFrame(ids, "tenant_id string, rank int, type string, value string, record_no long, gated boolean"),
        spark.createDataFrame([("t", r, g) for r, g in guest.items()], "tenant_id string, record_no long, guest_no long"),
        spark.createDataFrame([], RULE_SCHEMA), spark.createDataFrame([], SIDE_SCHEMA),
        spark.createDataFrame(queue, D.REVIEW_SCHEMA),
        spark.createDataFrame([("t", limit)], "tenant_id string, review_threshold int"),
    )


def asked(spark, made):
    rows = []
    for k, (kind, what) in enumerate(made):
        guest, records = what if kind == "UNMERGE" else (None, None)
        review = what if kind in ("CONFIRM", "REJECT") else None
        rule = what if kind == "LIFT_RULE" else None
        rows.append(("t", f"d{k:04}", kind, guest, records, review, rule, "HUMAN", "sam", None, T0 + timedelta(hours=1, seconds=k)))
    return spark.createDataFrame(rows, DECISION)


def counted(monkeypatch):
    seen = []
    plain = D.ready

    def ready(world, waiting):
        seen.append(1)
        return plain(world, waiting)

    monkeypatch.setattr(D, "ready", ready)
    return seen


def test_a_thousand_unrelated_unmerges_in_one_wave(spark, monkeypatch):
    """Every guest has three records that share an identifier; one is taken out of each."""
    n = 1000
    carried = {3 * g + k: [f"e{g}"] for g in range(n) for k in range(3)}
    world = world_from(spark, carried, {r: r - r % 3 for r in carried}, [])
    waves = counted(monkeypatch)
    after, events, errors = D.apply_decisions(world, asked(spark, [("UNMERGE", (3 * g, [3 * g + 2])) for g in range(n)]))
    assert len(waves) == 1 and errors.count() == 0
    links = {r.record_no: r.guest_no for r in after.links.collect()}
    assert all(links[3 * g] == links[3 * g + 1] == 3 * g != links[3 * g + 2] for g in range(n))
    assert len(set(links.values())) == 2 * n
    assert after.rules.count() == n and after.sides.count() == 3 * n
    kinds = {r.kind: r.n for r in events.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds == {"UNMERGE": n, "CREATE": n}


class Replay:
    """The same rules of the game on plain sets, one decision after the other."""

    def __init__(self, carried, guest, reviews):
        self.carried, self.guest, self.number = carried, dict(guest), itertools.count()
        self.reviews = {i: [r, c, "PENDING"] for i, r, c in reviews}
        self.rules, self.errors = {}, {}

    def barred(self, a, b):
        return frozenset((a, b)) in self.rules

    def members(self, g):
        return {r for r, k in self.guest.items() if k == g}

    def move_reviews(self, old, new):
        for review in self.reviews.values():
            if review[2] == "PENDING" and review[1] == old:
                review[1] = new

    def open(self, record, candidate):
        if not any(v == [record, candidate, "PENDING"] for v in self.reviews.values()):
            self.reviews[f"new{next(self.number)}"] = [record, candidate, "PENDING"]

    def unmerge(self, d, at, guest, records):
        mine = self.members(guest)
        out = list(dict.fromkeys(records))
        if len(mine) <= 1:
            self.errors[d] = "single source record"
        elif set(out) - mine:
            self.errors[d] = "not linked"
        else:
            stay = mine - set(out)
            for a in out:
                for b in stay:
                    self.rules.setdefault(frozenset((a, b)), d)
                del self.guest[a]
            for place, r in enumerate(out):
                near = {v: {self.guest[o] for o in self.guest if v in self.carried[o]} - {guest} for v in self.carried[r]}
                crowd = {v for v in near if sum(v in vs for vs in self.carried.values()) > LIMIT}
                found = set().union(*(near[v] for v in near if v not in crowd))
                taken, kept_off = [], []
                for g in sorted(found):
                    others = [r] + [x for t in taken for x in self.members(t)]
                    barred = any(self.barred(x, y) for x in others for y in self.members(g))
                    (kept_off if barred else taken).append(g)
                self.guest[r] = min(taken, default=at + place)
                for g in taken:
                    for x in self.members(g):
                        self.guest[x] = self.guest[r]
                    if g != self.guest[r]:
                        self.move_reviews(g, self.guest[r])
                for g in kept_off:
                    self.open(r, g)
                for v in crowd:
                    for g in near[v] - set(taken) - {self.guest[r]}:
                        self.open(r, g)
            if guest not in self.guest.values():
                self.reviews = {i: v for i, v in self.reviews.items() if v[1] != guest or v[2] != "PENDING"}

    def judge(self, d, kind, name):
        review = self.reviews.get(name)
        if review is None:
            self.errors[d] = "No review"
            return
        if review[2] != "PENDING":
            self.errors[d] = f"already {review[2]}"
            return
        record, candidate, _ = review
        own = self.guest[record]
        review[2] = "CONFIRMED" if kind == "CONFIRM" else "REJECTED"
        if kind == "CONFIRM":
            m = self.members(own) if own != candidate else {record}
            for a in m:
                for b in self.members(candidate):
                    self.rules.pop(frozenset((a, b)), None)
            if own != candidate:
                for x in self.members(own):
                    self.guest[x] = candidate
                self.move_reviews(own, candidate)
        elif own != candidate:
            for b in self.members(candidate):
                self.rules.setdefault(frozenset((record, b)), d)

    def lift(self, d, rule):
        by, a, b = rule.rsplit(":", 2)
        if self.rules.get(frozenset((int(a), int(b)))) != by:
            self.errors[d] = "No active rule"
        else:
            del self.rules[frozenset((int(a), int(b)))]


@pytest.mark.parametrize("seed", [2])
def test_equal_to_one_by_one(spark, monkeypatch, seed):
    rng = random.Random(seed)
    carried = {
        r: [f"e{r // 3}"] + ([f"f{r // 6}"] if rng.random() < 0.2 else []) + ([f"crowd{r % 2}"] if rng.random() < 0.2 else [])
        for r in range(72)
    }
    guest = {r: r - r % 3 for r in carried}
    guest = {r: g - 3 if g % 6 == 3 and any(f"f{g // 6}" in carried[x] for x in carried if guest[x] == g) else g for r, g in guest.items()}
    heads = sorted(set(guest.values()))
    reviews = [(f"r{k}", rng.choice(list(carried)), rng.choice(heads)) for k in range(14)]
    reviews = list({(r, c): (i, r, c) for i, r, c in reviews}.values())
    made = []
    for k in range(20):
        kind = rng.choice(["UNMERGE", "UNMERGE", "CONFIRM", "REJECT", "LIFT_RULE"])
        if kind == "UNMERGE":
            g = rng.choice(heads)
            mine = [r for r in guest if guest[r] == g]
            made.append((kind, (g, rng.sample(mine, rng.randrange(1, len(mine) + 1)) if rng.random() < 0.9 else [0, 71])))
        elif kind == "LIFT_RULE":
            j = rng.randrange(max(1, k))
            a, b = sorted(rng.sample(sorted(carried), 2))
            if made and made[j % len(made)][0] == "UNMERGE":
                g, out = made[j % len(made)][1]
                stay = [r for r in guest if guest[r] == g and r not in out]
                if stay:
                    a, b = sorted((out[0], stay[0]))
            made.append((kind, f"d{j:04}:{a}:{b}"))
        else:
            made.append((kind, rng.choice(reviews)[0] if rng.random() < 0.9 else "none"))
    replay = Replay(carried, guest, reviews)
    at = max(carried) + 1
    for k, (kind, what) in enumerate(made):
        if kind == "UNMERGE":
            replay.unmerge(f"d{k:04}", at, *what)
        elif kind == "LIFT_RULE":
            replay.lift(f"d{k:04}", what)
        else:
            replay.judge(f"d{k:04}", kind, what)
        at += len(what[1]) if kind == "UNMERGE" else 1
    waves = counted(monkeypatch)
    after, _, errors = D.apply_decisions(world_from(spark, carried, guest, reviews, LIMIT), asked(spark, made))
    assert {r.record_no: r.guest_no for r in after.links.collect()} == replay.guest
    found = {r.decision_id: r.error for r in errors.collect()}
    assert set(found) == set(replay.errors)
    assert all(replay.errors[d] in found[d] for d in found)
    rules = {frozenset((r.record_a, r.record_b)): r.decision_id for r in rule_pairs(after.rules.filter("lifted_at is null"), after.sides).collect()}
    assert rules == replay.rules
    queue = sorted((r.record_no, r.candidate, r.status) for r in after.reviews.collect())
    assert queue == sorted(map(tuple, replay.reviews.values()))
    assert len(waves) < len(made)


def test_reviews_are_decided_without_their_identifiers(spark):
    """Only an unmerge asks who carries an identifier: without one, a wave reads none of them."""
    world = world_from(spark, {r: ["e"] for r in range(6)}, {r: r for r in range(6)}, [("r0", 0, 1), ("r1", 2, 1), ("r2", 4, 5)])
    unread = D.replace(world, identifiers=None)
    after, events, errors = D.apply_decisions(unread, asked(spark, [("CONFIRM", "r0"), ("REJECT", "r1"), ("CONFIRM", "r2")]))
    links = {r.record_no: r.guest_no for r in after.links.collect()}
    assert links == {0: 1, 1: 1, 2: 2, 3: 3, 4: 5, 5: 5}
    assert events.count() == 3 and errors.count() == 0 and after.rules.count() == 1
