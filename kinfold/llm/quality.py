"""Quality rules with adaptive thresholds, in built-in functions only.

Every document gets a few measures. Instead of fixed cutoffs, quartiles of each measure are
estimated per language and source by mergeable quantile sketches (``percentile_approx`` merges
partial summaries of all tasks), and a document is refused if a measure lies far outside the
quartiles of its own group. The thresholds are joined back to the documents, with the hot source
dealt over several keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from kinfold.llm.names import unused
from kinfold.session import cut

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
# Summary size of a sketch: the rank error is at most one in this many.
SKETCH_ACCURACY = 10_000
# A measure is refused beyond this many quartile distances from the quartiles ...
FENCE = 3.0
# ... and a distance counts as this much at least, so a uniform group refuses no small difference.
LEAST_SPREAD = {
    "symbol_share": 0.05,
    "dup_line_share": 0.10,
    "repeat_share": 0.05,
    "word_length": 1.0,
}
HIGH_ONLY = ("symbol_share", "dup_line_share", "repeat_share")
SALTS = 32


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (a lambda variable instead of a copy)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = WINDOW_WORDS) -> Column:
    """Words that lie in a window of ``window`` words which occurs twice or more in the list.

    Windows are compared by 64-bit hashes. Only lists with a repeated window pay for the sort that
    finds which ones; covered words are the gaps between sorted starts, ``window`` at most each.
    """
    starts = F.sequence(F.lit(1), F.size(words) - (window - 1))

    def covered(hashes: Column) -> Column:
        numbered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(rows: Column) -> Column:
            def twin(row: Column, at: Column) -> Column:
                before = (at > 0) & (F.get(rows, at - 1)["h"] == row["h"])
                after = F.get(rows, at + 1)["h"] == row["h"]
                return before | F.coalesce(after, F.lit(False))

            places = F.sort_array(F.transform(F.filter(rows, twin), lambda row: row["i"]))
            return _let(places, gaps)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(
            _let(numbered, count)
        )

    def gaps(places: Column) -> Column:
        zero = F.struct(F.lit(0).alias("sum"), F.lit(-window).alias("last"))
        return F.aggregate(
            places, zero,
            lambda acc, p: F.struct(
                (acc["sum"] + F.least(F.lit(window), p - acc["last"])).alias("sum"), p.alias("last")
            ),
            lambda acc: acc["sum"],
        )

    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) < window, 0).otherwise(_let(hashes, covered))


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).

    A null text has no words. Columns of these names are replaced, all others are carried along
    whatever their names. Rows that repeat are measured each.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)
    words = F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))
    counted = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    lined = _let(
        lines,
        lambda kept: F.struct(
            F.size(kept).cast("long").alias("n_lines"),
            (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"),
        ),
    )
    of_words, of_lines = unused(docs.columns, "_counted", "_lined")
    return docs.withColumns(
        {
            of_words: counted,
            of_lines: lined,
            "word_chars": F.length(F.translate(whole, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        }
    ).withColumns(
        {
            "n_words": F.col(of_words)["n_words"],
            "n_repeat_words": F.col(of_words)["n_repeat_words"],
            "n_lines": F.col(of_lines)["n_lines"],
            "n_dup_lines": F.col(of_lines)["n_dup_lines"],
        }
    ).drop(of_words, of_lines)


def _shares() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }


def thresholds(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, _low, _high): the fences of every group, from its quantile sketches.

    Only documents that pass the base rules shape the fences. Null languages and sources are
    groups like others.
    """
    ok = measured.filter(~F.col("base_failed"))
    shares = _shares()
    quartiles = [
        F.percentile_approx(share, F.array(F.lit(0.25), F.lit(0.75)), F.lit(SKETCH_ACCURACY)).alias(name)
        for name, share in shares.items()
    ]
    fences = ok.groupBy(F.col(lang).alias("_lang"), F.col(source).alias("_source")).agg(*quartiles)
    low, high = {}, {}
    for name in shares:
        q1, q3 = F.col(name)[0], F.col(name)[1]
        spread = FENCE * F.greatest(q3 - q1, F.lit(LEAST_SPREAD[name]))
        high[name] = (q3 + spread).alias(name)
        low[name] = (F.lit(-1.0) if name in HIGH_ONLY else q1 - spread).alias(name)
    return fences.select(
        "_lang", "_source", F.struct(*low.values()).alias("_low"), F.struct(*high.values()).alias("_high")
    )


def judge(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """(doc_id, lang, source, measures, base_failed, kept), one row per row of ``docs``.

    Measures are written once, then sketched and joined. A null or wordless text fails the base
    rules; a group all of whose documents fail them has no fences and nothing to judge by them.
    """
    measured = base_measures(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    ).drop("text")
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    measured = cut(measured.withColumn("base_failed", failed))
    fences = thresholds(measured).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = measured.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    joined = salted.join(
        fences,
        F.col("lang").eqNullSafe(F.col("_lang"))
        & F.col("source").eqNullSafe(F.col("_source"))
        & (salted["_salt"] == fences["_salt"]),
        "left",
    )
    inside = F.lit(True)
    for name, share in _shares().items():
        inside = inside & (share >= F.col("_low")[name]) & (share <= F.col("_high")[name])
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return joined.select(*measured.columns, kept.alias("kept"))


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the rules keep, with their own columns; ``doc_id`` must be a key."""
    kept = judge(docs, doc_id, text).filter("kept").select(F.col("doc_id").alias("_kept"))
    return docs.join(kept, F.col(doc_id) == F.col("_kept"), "left_semi")
