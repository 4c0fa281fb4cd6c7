"""Value tables for the column functions and the vectorised text functions."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.functions import text as X
from kinfold.functions.phonetic import primary_code
from kinfold.functions.similarity import register, similarities
from kinfold.sources.envelope import lookup_candidates
from kinfold.sources.extract import block_key_rows, extract


def column(spark, values, make):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v string")
    return [r.x for r in df.select("n", make(F.col("v")).alias("x")).orderBy("n").collect()]


def test_email(spark):
    given = ["  Anna.Muster@Example.COM ", "not-an-email", "a@b", "two@@example.com", "   ", None]
    assert column(spark, given, X.email) == ["anna.muster@example.com"] + [None] * 5


def test_phone(spark):
    given = ["+41 79 123 45 67", "079 123 45 67", "call me maybe", "+00 00", None, "0041 79 123 45 67"]
    assert column(spark, given, X.phone) == ["+41791234567"] + [None] * 5
    swiss = column(spark, given, lambda c: X.phone(c, "CH"))
    assert swiss == ["+41791234567", "+41791234567", None, None, None, "+41791234567"]


def test_fold(spark):
    given = [" Müller ", "MÜLLER", "François", "Ångström", "Anna-Lena", "van der Berg", "   ", None, "각"]
    expected = ["muller", "muller", "francois", "angstrom", "anna-lena", "van der berg", None, None, "각"]
    assert column(spark, given, X.fold) == expected


def test_document_hash(spark):
    made = column(spark, ["x123 4567"], lambda c: X.id_document(F.lit(" passport "), c))
    assert made == ["d7b5e20051ccd2e7a7e7f872580ca6bcdc414f372a543dc0fa6e08c4c86529e8"]


def test_dates_and_instants(spark):
    dates = column(spark, ["1985-03-12", " 1985-03-12 ", "1985", "1985-02-30", "12.03.1985"], X.iso_date)
    assert [str(d) if d else None for d in dates] == ["1985-03-12", "1985-03-12", None, None, None]
    given = ["2026-01-01T00:00:00Z", "2026-01-01", "2026-13-01T00:00:00Z", "2026-01-01T00:00:00"]
    assert [v is not None for v in column(spark, given, X.iso_instant)] == [True, False, False, False]


def test_score_rounds_half_up(spark):
    assert [str(v) for v in column(spark, ["0.1235", "0.9994"], lambda c: X.score3(c.cast("double")))] == ["0.124", "0.999"]


@pytest.mark.parametrize(
    "a, b, expected",
    [("muller", "mueller", 0.917460), ("schmidt", "schmitt", 0.942857), ("muller", "miller", 0.9),
     ("catherine", "kathryn", 0.756614), ("anna", "hannah", 0.888889), ("same", "same", 1.0), ("ab", "xy", 0.0)],
)
def test_jaro_winkler(a, b, expected):
    assert similarities(pd.Series([a]), pd.Series([b]))[0] == pytest.approx(expected, abs=1e-6)


def test_text_functions_agree_with_the_libraries_spark_ships(spark):
    codec = spark._jvm.org.apache.commons.codec.language.DoubleMetaphone()
    winkler = spark._jvm.org.apache.commons.text.similarity.JaroWinklerSimilarity()
    random.seed(7)
    parts = "sch ch cc ck wicz tth tia sh sc ier eau x umb mac ps kn wr jose ge gg dg w owski cz cia h ph zh z s isl b c d f g j k l m n p q r t v a e i o u".split()
    words = ["".join(random.choices(parts, k=random.randint(1, 5))) for _ in range(800)]
    assert [primary_code(w) for w in words] == [codec.doubleMetaphone(w) for w in words]
    pairs = list(zip(words, random.sample(words, len(words))))[:400]
    mine = similarities(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]))
    assert list(mine) == pytest.approx([winkler.apply(a, b) for a, b in pairs], abs=1e-12)


def test_sql_registration(spark):
    register(spark)
    row = spark.sql("select jaro_winkler('muller', 'mueller') j, metaphone('muller') m, jaro_winkler(null, 'a') n").first()
    assert row.j == pytest.approx(0.91746, abs=1e-5) and row.m == "MLR" and row.n is None


PERSON = "tenant_id string, source_system string, firstName string, lastName string, birthdate string, email string, phone string"


def keys_of(spark, *row):
    df = extract(spark.createDataFrame([("t", "pms", *row)], PERSON))
    return {r.type: r.value for r in block_key_rows(df).collect()}


def test_block_keys(spark):
    found = keys_of(spark, "Anna", "Müller", "1985-03-12", "Anna.M@example.com", "+41791234567")
    assert found == {
        "NAME_PHONETIC_BIRTHYEAR": "MLR:1985", "NAME_INITIALS_BIRTHDATE": "am:1985-03-12",
        "PHONE_SUFFIX7": "1234567", "EMAIL_LOCALPART": "anna.m",
    }
    assert keys_of(spark, "Anna", "Mueller", "1985-03-12", None, None)["NAME_PHONETIC_BIRTHYEAR"] == "MLR:1985"
    assert keys_of(spark, None, None, None, "x1@guest.booking.com", None) == {"EMAIL_MASKED": "x1@guest.booking.com"}
    assert keys_of(spark, None, None, None, None, None) == {}


def test_lookup_candidates(spark):
    asked = spark.createDataFrame(
        [(" Anna@Example.com ", None), ("PASSPORT:X1234567", "ID_DOCUMENT"), ("PASSPORT:X1234567", None)], "raw string, type string")
    found = {(r.raw, r.type, r.value) for r in lookup_candidates(asked).collect()}
    assert (" Anna@Example.com ", "EMAIL", "anna@example.com") in found
    assert ("PASSPORT:X1234567", "ID_DOCUMENT", "d7b5e20051ccd2e7a7e7f872580ca6bcdc414f372a543dc0fa6e08c4c86529e8") in found
    assert not any(t == "ID_DOCUMENT" and len(v) != 64 for _, t, v in found) and len(found) == 6
