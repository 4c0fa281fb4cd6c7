"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinfold.llm import jaccard, langid, mixing, packing, suffix_dedup
from kinfold.llm.names import unused
from kinfold.llm.tables import documents
from kinfold.session import cut

# A document whose best language is less probable than this is rejected, as is one without letters.
LEAST_LANGUAGE_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the network recognises.

    It learns from a bounded sample of the labelled documents. Null texts and texts without letters
    are rejected. Rows that repeat are judged alike; all columns are carried along.
    """
    network = langid.fit(docs)
    lang, score = unused(docs.columns, "_lang", "_score")
    found = langid.predict(docs, network, lang=lang, score=score)
    good = (F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)
    return found.filter(good).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of every group of near duplicates (five words, 0.8 or more).

    Null and empty texts and rows without an id all stay; of rows with one id one stays.
    """
    return jaccard.keep_first(docs)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out strings of 50 bytes or more that an earlier document has; nothing left, no row.

    A character that loses some of its bytes goes whole. A null text stays an empty one.
    """
    found = suffix_dedup.remove_repeats(docs)
    text = F.col("kept").cast("string")
    text = F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit("")))
    left = found.withColumn("_text", text).filter((F.length("_text") > 0) | (F.col("n_bytes") == 0))
    own = {
        "doc_id": F.col("doc_id"), "text": F.col("_text"), "n_chars": F.length("_text").cast("long"),
    }
    return left.select(*((own[c] if c in own else F.col("other")[c]).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every source to its target share, repeats as rows, in the order of training.

    Null sources are one source; all columns are carried along.
    """
    (position,) = unused(docs.columns, "_position")
    return mixing.mix(docs, name=position).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, each piece with its place in a sequence of 1024 tokens.

    A null or empty text is its end token alone; rows that repeat are packed each.
    """
    pieces = packing.token_pieces(docs).withColumn("ids_crc32", F.crc32("ids"))
    return packing.best_fit_pack(pieces)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeated_strings),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# A trained network, suffix sorting and best-fit packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = cut(docs)
    return docs
