"""Prefix counts against the library, prefix by prefix."""

import sentencepiece
from public_tokenizers import path
from pyspark.sql import functions as F

from kinfold.llm import token_counts as T
from kinfold.llm.queries import op6_token_counts

TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "hello world", "Hello,\n\nworld!\t", "naïve café 東京 ",
    "▁mark ▁▁ inside", "<s> and </s> <unk>", "x" * 3000, "   lead", "é" * 40, "\u0000odd﻿", "🙂🙃 ok",
    "aaaa bbbbb aaaa", "The quick brown foxes' internationalization",
]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=path(T.DEFAULT_MODEL))


def frame(spark, texts):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_every_prefix_matches_the_library(spark):
    exact = library()
    rows = T.prefix_counts(frame(spark, TEXTS)).select("doc_id", "prefix_tokens").collect()
    assert len(rows) == len(TEXTS)
    for doc, counts in rows:
        text = TEXTS[doc] or ""
        step = 1 if len(text) < 200 else 97
        assert len(counts) == len(text) + 1
        for n in range(0, len(text) + 1, step):
            assert counts[n] == len(exact.encode(text[:n])), (text, n)


def test_the_program_itself_is_exact_on_the_corpus(spark, sf_small):
    """The library is never needed in place of the program, and totals agree on every document."""
    texts = [r[0] for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("text").collect()]
    counter = T.PrefixCounter(T.DEFAULT_MODEL)
    words = [counter.split(t or "") for t in texts]
    counter.prepare(words)
    assert counter.checked_by_library == 0
    exact = library()
    for text, split in zip(texts, words, strict=True):
        assert counter.total(split) == len(exact.encode(text or ""))
    word = max(counter.words, key=len)
    whole = T.WORD_MARK + word
    assert list(counter.words[word]) == [len(counter.plain.encode(whole[:n])) for n in range(1, len(whole) + 1)]


def test_questions_need_no_encoding(spark):
    docs = T.prefix_counts(frame(spark, ["hello big world", "", None]))
    rows = docs.select(
        "text", T.tokens_at("prefix_tokens", 9).alias("at"), T.longest_prefix("prefix_tokens", 2).alias("fit"),
        T.longest_prefix("prefix_tokens", -1).alias("none"),
    ).collect()
    exact = library()
    text, at, fit, none = rows[0]
    assert at == len(exact.encode(text[:9])) and none is None
    assert fit == max(n for n in range(len(text) + 1) if len(exact.encode(text[:n])) <= 2)
    assert [(r.at, r.fit) for r in rows[1:]] == [(0, 0), (0, 0)]


def test_query(spark, sf_small):
    exact = library()
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in op6_token_counts(spark, sf_small).collect()}
    assert len(rows) == len(docs)
    for doc, text in docs:
        n = len(exact.encode(text or ""))
        assert (rows[doc].n_tokens, rows[doc].n_bytes, rows[doc].over_limit) == (n, len((text or "").encode()), n > 4096)


def test_empty_table_and_repeated_rows(spark):
    assert T.token_counts(frame(spark, [])).count() == 0
    twice = frame(spark, ["a b", "a b"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r.n_tokens for r in T.token_counts(twice).collect()] == [2, 2]
