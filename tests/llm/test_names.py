"""Columns of the caller's whose names an operator would like to use itself."""

from kinfold.llm import langid, mixing, packing, quality
from kinfold.llm.names import unused


def test_names_are_unused():
    assert unused(["_Row", "__row", "x"], "_row", "_row", "y") == ["___row", "____row", "y"]


def test_mix_carries_every_column(spark):
    names = ["_size", "_source", "_key", "_place", "position", "extra0", "_copies"]
    rows = [(i, f"s{i % 2}", "a b c", *(f"{n}{i}" for n in names)) for i in range(6)]
    docs = spark.createDataFrame(rows, ["doc_id", "source", "text", *names])
    mixed = mixing.mix(docs, name="at")
    assert mixed.columns == [*docs.columns, "at"]
    got = mixed.collect()
    assert got and {tuple(r)[:-1] for r in got} <= set(rows)
    assert [r["at"] for r in got] == sorted(r["at"] for r in got)
    replaced = mixing.mix(docs)
    assert replaced.columns == [c for c in docs.columns if c != "position"] + ["position"]
    assert sorted(r.position for r in replaced.collect()) == sorted(r["at"] for r in got)


def test_packing_carries_every_column(spark):
    items = spark.createDataFrame([(i, 5, f"r{i}", i, i) for i in range(9)], "i int, length int, _row string, _bin int, _part int")
    got = packing.best_fit_pack(items, size=10).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted((i, 5, f"r{i}", i, i) for i in range(9))
    assert sorted(r.offset for r in got) == [0] * 5 + [5] * 4


def test_measures_carry_every_column(spark):
    docs = spark.createDataFrame([("a b", "x", "y"), (None, "u", "v")], "text string, _counted string, _lined string")
    got = quality.base_measures(docs).collect()
    assert sorted((r._counted, r._lined, r.n_words, r.n_lines) for r in got) == [("u", "v", 0, 0), ("x", "y", 2, 1)]


def test_language_carries_every_column(spark):
    docs = spark.createDataFrame(
        [(i, t, lang, "f", i) for i, (t, lang) in enumerate([("the old house", "en"), ("das alte Haus", "de")] * 4)]
        + [(8, None, None, "f", 8), (9, "12 34", "en", "f", 9)],
        "doc_id long, text string, lang string, _found string, _readable int",
    )
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert len(got) == 10 and all(r._found == "f" and r._readable == r.doc_id for r in got)
    assert {r.lang_pred for r in got if r.doc_id > 7} == {"und"}
