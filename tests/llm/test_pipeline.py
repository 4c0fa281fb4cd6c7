"""Every stage of the pipeline on its own input, by brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from kinfold.session import cut
from tests.llm.test_jaccard import brute as near_groups
from tests.llm.test_mixing import brute_targets
from tests.llm.test_packing import check_places
from tests.llm.test_suffix_dedup import brute as removed


@pytest.fixture(scope="module")
def steps(spark, sf_small):
    tables = [spark.read.parquet(f"{sf_small}/documents.parquet")]
    for _, stage in C.STAGES:
        tables.append(cut(stage(spark, tables[-1], sf_small)))
    return tables


def test_columns(steps):
    assert all(t.schema.simpleString() == steps[0].schema.simpleString() for t in steps[:-1])


def test_language(steps):
    before, after = ({r.doc_id: r for r in t.collect()} for t in steps[:2])
    assert all(after[i] == before[i] for i in after)
    gone = [r for i, r in before.items() if i not in after]
    assert all(i in after for i, r in before.items() if r.lang and sum(c.isalpha() for c in r.text or "") > 100)
    assert len(gone) <= 0.02 * len(before)


def test_near_duplicates(steps):
    rows = steps[1].collect()
    groups = near_groups([(r.doc_id, r.text) for r in rows], 5, 80, 100)
    assert sorted(steps[2].collect()) == sorted(r for r in rows if groups[r.doc_id][1] == r.doc_id)


def test_suffix_dedup(steps):
    rows = [(r.doc_id, r.text.encode()) for r in steps[2].collect()]
    want = {i: kept.decode(errors="ignore") for i, _, kept, _ in removed(rows, 50)}
    got = {r.doc_id: r for r in steps[3].collect()}
    assert {i: r.text for i, r in got.items()} == {i: t for i, t in want.items() if t}
    assert all(r.n_chars == len(r.text) for r in got.values())


def words(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mixing(steps):
    before = steps[3].collect()
    after = steps[4].collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r.source] += words(r.text)
    for r in after:
        taken[r.source] += words(r.text)
    want = brute_targets(dict(sizes), (5, 2, 1), 3)
    largest = max(words(r.text) for r in before)
    assert all(abs(taken[s] - want[s]) <= largest for s in want)
    assert max(Counter(r.doc_id for r in after).values()) <= 3
    assert set(after) <= set(before)


def test_packing(steps):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = Counter()
    for r in steps[4].collect():
        ids = np.array(library.encode(r.text, add_special_tokens=False).ids + [2], "<u4")
        want[r.doc_id, len(ids)] += 1
    rows = steps[5].collect()
    check_places(rows, 1024)
    sums = Counter()
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        sums[r.doc_id] += r.length
    total = Counter()
    for (doc, n), times in want.items():
        total[doc] += n * times
    assert sums == total


def test_run_and_nulls(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 34", "en", None, 5), (None, "the plain words of a text", "en", "s", 25),
            (5, "les mots d'un texte", "fr", None, 19), (5, "les mots d'un texte", "fr", None, 19)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        found = C.run(spark, f"{tmp_path}/{name}")
        assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(found.columns)
        ids = {r.doc_id for r in found.collect()}
        assert ids <= {None, 5} and bool(ids) == (name == "some")


def test_stages_carry_every_column(spark, sf_small):
    names = ["_text", "_lang", "_score", "_size", "_position", "_gone", "row", "kept", "other", "n_bytes"]
    given = spark.read.parquet(f"{sf_small}/documents.parquet").limit(60)
    docs = cut(given.select("*", *(F.concat(F.lit(n), "doc_id").alias(n) for n in names)))
    for _, stage in C.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_small))
        assert docs.columns == [*given.columns, *names]
        got = docs.collect()
        assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
