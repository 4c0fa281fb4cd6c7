"""Components of the shingle join against all pairs by brute force."""

import random
import re

import pytest

from kinfold.llm import jaccard as J
from kinfold.llm.shingles import shingle_sets
from tests.llm.oracle import same_as_sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def brute(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if a < b and s and t and den * len(s & t) >= num * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    texts = [None, "", " \t", "one", "One", "one two", "ONE  two\n", "one two three", "É é é"]
    passage = [word() for _ in range(40)]
    base = [word() for _ in range(60)]
    for n in range(70):
        kind = n % 5
        if kind < 2:  # near copies of one text
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
        elif kind == 2:  # a chain: each link close to the next only
            w = [f"c{j}" for j in range(n, n + 80)]
            texts.append(" ".join(w))
        elif kind == 3:  # a passage that many share
            texts.append(" ".join([word() for _ in range(rng.randint(1, 60))] + passage))
        else:
            texts.append(" ".join("the" if rng.random() < 0.6 else word() for _ in range(rng.randint(1, 30))))
    return texts + [texts[12], texts[12].upper(), " ".join(base)]


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_against_brute_force(spark, k, num, den):
    rows = [(i * 3 + 1, t) for i, t in enumerate(corpus(k))]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n int, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs, words=k, num=num, den=den).collect()}
    assert got == brute(rows, k, num, den)
    kept = J.keep_first(docs, words=k, num=num, den=den)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got.values()})


def test_nulls_repeats_and_empty(spark):
    schema = "doc_id long, text string"
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(None, long), (None, "x"), (7, long), (7, long), (9, long + " z"), (9, "other words here"), (4, "other words here")]
    got = sorted(map(tuple, J.jaccard_components(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 36, None), (None, 1, None), (7, 36, 4), (7, 36, 4), (9, 37, 4), (9, 1, 4), (4, 1, 4)], key=str)
    assert J.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    kept = J.keep_first(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(None, long), (None, "x"), (4, "other words here")], key=str)


def test_clashing_names_and_ties(spark):
    rows = [(7, "b c d", 1, "x"), (7, "a c d", 2, "y"), (9, "a c d", 3, "z"), (None, "a", 4, "u"), (None, "a", 4, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone long, row string")
    kept = J.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(7, "a c d", 2, "y"), *rows[3:]], key=str)


def test_hashes_follow_the_words():
    texts = ["A b  C", "a\tb c", "a b cd", None, "é É", "b c"]
    sets = [frozenset(s.tolist()) for s in shingle_sets(texts, 2)]
    assert sets[0] == sets[1] and len(sets[0]) == 2 and len(sets[0] & sets[2]) == 1
    assert sets[3] == frozenset() and sets[5] < sets[0] and len(sets[4]) == 1


def test_query(spark, sf_small):
    assert same_as_sql(spark, "op4_ngram_jaccard", sf_small) > 0


def test_blocks_of_texts_are_deleted_once_used(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b c d e f {i % 3}") for i in range(9)], "doc_id long, text string")
    monkeypatch.setattr("kinfold.session.shared_folder", lambda _: str(tmp_path))
    found = J.jaccard_components(docs, words=3, num=90, den=100)
    left = [spark.read.parquet(str(p)).columns for p in tmp_path.glob("kinfold-*")]
    assert left and not any("data" in columns for columns in left)
    assert {(r["doc_id"], r["component_id"]) for r in found.collect()} == {(i, i % 3) for i in range(9)}
