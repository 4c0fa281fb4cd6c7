"""License scans: whole notices, altered notices, lookalikes, and the SQL of the corpus."""

import pytest

from kinfold.llm import licenses as L
from tests.llm.oracle import same_as_sql

SCHEMA = "doc_id long, text string, license string"
FILL = " ".join(f"word{i}" for i in range(500))


def found(spark, texts):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)
    return {(r.doc_id, r.license): r for r in L.scan_licenses(docs).collect()}


def test_every_template_at_every_place(spark):
    texts, want = [], []
    for k, (name, body) in enumerate(L.TEMPLATES):
        for shift in (0, 1, 7, 33):
            lead = " ".join(f"w{k}x{i}" for i in range(shift))
            texts.append(f"{lead}\n{body.upper()}\n{FILL}")
            want.append(name)
    got = found(spark, texts)
    assert all(got[i, name].containment == 1 for i, name in enumerate(want))
    # Two of the wordings differ in one word and hold each other.
    assert {x for x in got if x not in set(enumerate(want))} <= {(i, n) for i in range(len(want)) for n in ("CC-BY-4.0", "CC-BY-SA-4.0")}


def test_alterations(spark):
    body = L.TEMPLATES[5][1].split()
    near = " ".join(body[:10] + ["EDITED"] + body[11:])
    far = " ".join(w if i % 3 else "other" for i, w in enumerate(body))
    got = found(spark, [near, far, FILL, "the license of the MIT is not released", None, "", f"{near} {near}"])
    assert set(got) == {(0, "GPL-3.0"), (6, "GPL-3.0")}
    assert 0.8 <= got[0, "GPL-3.0"].containment < 1


def test_long_text_repeats_and_empty(spark):
    text = f"{FILL} " * 400 + L.TEMPLATES[2][1]
    docs = spark.createDataFrame([(1, text, None)] * 2 + [(None, L.TEMPLATES[7][1], None)], SCHEMA)
    rows = L.scan_licenses(docs).collect()
    assert sorted((r.doc_id or 0, r.license) for r in rows) == [(0, "CC-BY-NC-4.0"), (1, "MIT"), (1, "MIT")]
    assert max(r.first_word for r in rows) > 190_000
    assert L.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        L.Library((("x", "one"),))


def test_query(spark, sf_check):
    assert same_as_sql(spark, "op7_license_scan", sf_check) > 10
