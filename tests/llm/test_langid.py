"""Held-out accuracy, the window cover, gradients and odd inputs of the byte network."""

import zlib

import numpy as np
import pytest

from kinfold.llm import langid as L
from kinfold.llm.queries import op8_language_id


def test_windows_cover_every_filter_place():
    for n in (0, 1, 255, 256, 257, 509, 510, 5000):
        data = bytes(i % 251 for i in range(n))
        windows = L.text_windows(data)
        seen = {w.tobytes()[i : i + 4] for w in windows for i in range(253)}
        assert all(data[i : i + 4] in seen for i in range(n - 3))


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    windows = rng.integers(97, 123, (6, L.WINDOW_BYTES)).astype(np.uint8)
    labels = np.array([0, 1, 2, 0, 1, 2])
    n = L.FILTERS * len(L.WIDTHS)
    net = L.ByteNetwork(
        list("abc"), [rng.normal(0, 0.5, (w, 256, L.FILTERS)) for w in L.WIDTHS],
        rng.normal(0, 0.1, n), rng.normal(0, 0.5, (n, 3)), np.zeros(3),
    )
    weights = np.ones(3)

    def loss():
        last = L.WINDOW_BYTES - 3
        peaks = [sum(k[j][windows[:, j : j + last]] for j in range(len(k))).max(1) for k in net.filters]
        logits = np.maximum(np.concatenate(peaks, 1) + net.bias, 0) @ net.dense + net.offset
        return float(np.mean(np.log(np.exp(logits).sum(1)) - logits[np.arange(6), labels]))

    params = [*net.filters, net.bias, net.dense, net.offset]
    for p, grad in zip(params, L._gradients(net, windows, labels, weights), strict=True):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old, e = p[at], 1e-6
        p[at] = old + e
        up = loss()
        p[at] = old - e
        down = loss()
        p[at] = old
        assert (up - down) / (2 * e) == pytest.approx(grad[at], rel=1e-3, abs=1e-7)


def test_pair_tables_equal_the_filters():
    rng = np.random.default_rng(2)
    windows = rng.integers(0, 256, (3, L.WINDOW_BYTES)).astype(np.uint8)
    net = L.ByteNetwork(["a", "b"], [rng.normal(0, 1, (w, 256, 8)).astype(np.float32) for w in L.WIDTHS],
                        np.zeros(24, np.float32), rng.normal(0, 1, (24, 2)).astype(np.float32), np.zeros(2, np.float32))
    last = L.WINDOW_BYTES - 3
    peaks = [sum(k[j][windows[:, j : j + last]] for j in range(len(k))).max(1) for k in net.filters]
    logits = np.maximum(np.concatenate(peaks, 1), 0) @ net.dense
    want = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    assert np.allclose(L.probabilities(net, net.pair_tables(), windows), want, atol=1e-4)


def test_query_accuracy(spark, sf_check):
    truth = {r.doc_id: (r.text, r.lang) for r in spark.read.parquet(f"{sf_check}/documents.parquet").collect()}
    rows = op8_language_id(spark, sf_check).collect()
    assert len(rows) == len(truth)
    right = held = 0
    for r in rows:
        text, lang = truth[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        letters = any(c.isalpha() for c in text or "")
        assert (r.lang_pred == "und") == (not letters)
        if r.held_out and letters and lang:
            held += 1
            right += r.lang_pred == lang
    assert right / held >= 0.95, (right, held)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(1, None, "en", "x"), (2, "", "en", "x"), (3, "123 --", "en", "x"), (None, "the words", None, None), (4, "le é " * 100_000, "fr", "x")]
    docs = spark.createDataFrame(rows, schema)
    network = L.fit(docs)
    assert network.languages == ["fr"]
    got = {r.text and r.text[:5]: (r.lang_pred, r.score) for r in L.predict(docs, network).collect()}
    assert got[None] == got[""] == got["123 -"] == ("und", 0.0)
    assert got["the w"][0] == "fr"
    empty = spark.createDataFrame([], schema)
    assert L.fit(empty) is None
    assert L.predict(docs, None).filter("lang_pred <> 'und'").count() == 0
    assert L.predict(empty, network).count() == 0


def test_copies_do_not_fill_the_sample(spark):
    """A text with thousands of copies gives two windows at most, and a label its bound at most."""
    from kinfold.llm import langid

    for copied in range(6):
        rows = [(f"copy number {copied} " * 40, "xx")] * 2000 + [(f"text {i} of {copied} " * 40, "xx") for i in range(400)]
        docs = spark.createDataFrame(rows, "text string, lang string")
        windows, _, _ = langid.training_sample(docs, per_label=300)
        assert 400 <= len(windows) <= 600
        assert sum(bytes(w).count(b"copy number") > 0 for w in windows) <= 2
