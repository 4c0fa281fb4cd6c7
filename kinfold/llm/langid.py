"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows, each keeps its maximum over
the window, and a softmax layer turns the maxima into probabilities. The network is trained in
numpy on the driver, on a bounded sample of labelled documents; prediction runs in the tasks over
all windows of every whole text and averages their probabilities.

A filter over bytes is a table per position. For prediction the tables of neighbouring positions
are added up into tables over byte pairs, so a window costs two lookups per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.llm.names import unused

WINDOW_BYTES = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
# Bound of the training sample: at most so many distinct texts of each language, two windows from each.
TRAIN_DOCUMENTS = 1000
# More are drawn than kept, as distinct texts are counted by a sketch.
SPARE = 1.25
MOST_LABELS = 5000
EPOCHS = 8
BATCH = 64
RATE = 0.01
SEED = 7
UNKNOWN = "und"
# Windows that are scored at once.
CHUNK = 1024


@dataclass
class ByteNetwork:
    """``filters[w]``: (width, 256, FILTERS); ``dense``: (all filters, languages)."""

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What bytes i, i+1 and bytes i+2, i+3 add to every filter at i, by pair of bytes."""
        first = np.arange(65536) & 255
        second = np.arange(65536) >> 8
        heads, tails = [], []
        for kernel in self.filters:
            heads.append(kernel[0][first] + kernel[1][second])
            tail = np.zeros((65536, kernel.shape[2]), np.float32)
            if len(kernel) > 2:
                tail += kernel[2][first]
            if len(kernel) > 3:
                tail += kernel[3][second]
            tails.append(tail)
        return np.concatenate(heads, 1), np.concatenate(tails, 1)


def text_windows(data: bytes, length: int = WINDOW_BYTES, reach: int = max(WIDTHS)) -> np.ndarray:
    """Windows that cover all bytes; neighbours overlap so that no filter position is lost.

    A shorter text is one window filled up with zero bytes; the last window ends with the text.
    """
    if len(data) <= length:
        return np.frombuffer(data.ljust(length, b"\0"), np.uint8)[None, :]
    starts = np.arange(0, len(data) - length, length - reach + 1)
    starts = np.append(starts, len(data) - length)
    return np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), length)[starts]


def _pairs(windows: np.ndarray) -> np.ndarray:
    return windows[:, :-1].astype(np.intp) | (windows[:, 1:].astype(np.intp) << 8)


def probabilities(network: ByteNetwork, tables: tuple[np.ndarray, np.ndarray], windows: np.ndarray) -> np.ndarray:
    """Softmax output of every window."""
    pairs = _pairs(windows)
    values = tables[0][pairs[:, :-2]]
    values += tables[1][pairs[:, 2:]]
    logits = np.maximum(values.max(1) + network.bias, 0) @ network.dense + network.offset
    logits -= logits.max(1, keepdims=True)
    e = np.exp(logits)
    return e / e.sum(1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str]) -> ByteNetwork:
    """Fit the network by Adam on cross entropy; every language weighs the same in all."""
    rng = np.random.default_rng(SEED)
    n = FILTERS * len(WIDTHS)
    net = ByteNetwork(
        languages,
        [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(n, np.float32),
        rng.normal(0, 0.3, (n, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    weights = 1.0 / np.bincount(labels, minlength=len(languages)).clip(1)
    weights = (weights / weights[labels].mean()).astype(np.float32)
    params = [*net.filters, net.bias, net.dense, net.offset]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            step += 1
            for p, grad, m, v in zip(params, _gradients(net, windows[rows], labels[rows], weights), first, second, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: ByteNetwork, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    places, peaks = [], []
    last = windows.shape[1] - max(WIDTHS) + 1
    for kernel in net.filters:
        values = kernel[0][windows[:, :last]].copy()
        for j in range(1, len(kernel)):
            values += kernel[j][windows[:, j : j + last]]
        places.append(values.argmax(1))
        peaks.append(values.max(1))
    pooled = np.concatenate(peaks, 1) + net.bias
    hidden = np.maximum(pooled, 0)
    logits = hidden @ net.dense + net.offset
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(labels)), labels] -= 1
    p *= (weights[labels] / len(labels))[:, None]
    back = (p @ net.dense.T) * (pooled > 0)
    out = []
    rows = np.arange(len(windows))[:, None]
    for k, kernel in enumerate(net.filters):
        grad = np.zeros_like(kernel)
        part = back[:, k * FILTERS : (k + 1) * FILTERS]
        for j in range(len(kernel)):
            np.add.at(grad[j], (windows[rows, places[k] + j], np.arange(FILTERS)[None, :]), part)
        out.append(grad)
    return [*out, back.sum(0), hidden.T @ p, p.sum(0)]


def fold(doc_id: str = "doc_id") -> Column:
    """Checksum of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def training_sample(
    docs: DataFrame, label: str = "lang", text: str = "text", per_label: int = TRAIN_DOCUMENTS, seed: int = SEED
) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows and labels of about ``per_label`` distinct texts of each label, never more, drawn by a hash.

    Each text gives its window at a hashed place and one at its start, however many documents have
    it. Distinct texts are counted by sketches; only windows of the drawn ones leave their tasks.
    """
    named = docs.select(F.col(label).alias("label"), F.col(text).alias("text")).filter(
        F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    texts = named.groupBy("label").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("texts"))
    counts = {r["label"]: max(r["texts"], 1) for r in texts.limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels are no languages")
    if not counts:
        return np.zeros((0, WINDOW_BYTES), np.uint8), np.zeros(0, np.int64), []
    rates = F.create_map(*(F.lit(x) for label, n in sorted(counts.items()) for x in (label, SPARE * per_label / n)))
    draw = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    place = F.pmod(F.xxhash64("text", F.lit(seed + 1)), F.greatest(F.length("text") - WINDOW_BYTES, F.lit(1)))
    drawn = named.filter(draw < F.element_at(rates, F.col("label"))).select(
        "label",
        F.array(
            F.substring("text", 1, WINDOW_BYTES), F.substring(F.col("text"), (place + 1).cast("int"), F.lit(WINDOW_BYTES))
        ).alias("parts"),
        draw.alias("_draw"), F.xxhash64("text", F.lit(seed + 2)).alias("_text"),
    )
    # Copies fall away before the shuffle; the lowest draws of a label are kept.
    distinct = drawn.groupBy("label", "_draw", "_text").agg(F.min("parts").alias("parts"))
    lowest = Window.partitionBy("label").orderBy("_draw", "_text")
    drawn = distinct.withColumn("_n", F.row_number().over(lowest)).filter(F.col("_n") <= per_label)
    rows = sorted((r.label, part) for r in drawn.toLocalIterator() for part in set(r.parts))
    languages = sorted({label for label, _ in rows})
    windows = [np.frombuffer(p.encode()[:WINDOW_BYTES].ljust(WINDOW_BYTES, b"\0"), np.uint8) for _, p in rows]
    index = {label: i for i, label in enumerate(languages)}
    labels = np.array([index[label] for label, _ in rows], np.int64)
    return np.array(windows).reshape(-1, WINDOW_BYTES), labels, languages


def fit(docs: DataFrame, label: str = "lang", text: str = "text", per_label: int = TRAIN_DOCUMENTS) -> ByteNetwork | None:
    """A network for the labels of ``docs``; None if no document has both a label and a letter."""
    windows, labels, languages = training_sample(docs, label, text, per_label)
    return train(windows, labels, languages) if languages else None


def _score(network: ByteNetwork, tables: tuple[np.ndarray, np.ndarray], texts: pd.Series) -> pd.DataFrame:
    sums = np.zeros((len(texts), len(network.languages)))
    counts = np.zeros(len(texts))
    waiting: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if held:
            windows, owner = np.concatenate(waiting), np.concatenate(owners)
            for at in range(0, len(windows), CHUNK):
                p = probabilities(network, tables, windows[at : at + CHUNK])
                np.add.at(sums, owner[at : at + CHUNK], p)
            np.add.at(counts, owner, 1)
        waiting.clear()
        owners.clear()
        held = 0

    for row, text in enumerate(texts):
        if text:
            windows = text_windows(text.encode())
            waiting.append(windows)
            owners.append(np.full(len(windows), row))
            held += len(windows)
            if held >= CHUNK:
                flush()
    flush()
    mean = sums / counts.clip(1)[:, None]
    best = mean.argmax(1)
    score = mean[np.arange(len(mean)), best] if len(mean) else np.zeros(0)
    return pd.DataFrame({"lang": np.array(network.languages, object)[best], "score": score.clip(0, 1)})


def predict(
    docs: DataFrame, network: ByteNetwork | None, text: str = "text", lang: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """Add the most probable language and its mean probability over all windows of the text.

    A null text, one without letters, and any text where there is no network are ``und`` at 0.
    Columns of the two names are replaced, all others are carried along whatever their names; rows
    are neither dropped nor moved.
    """
    readable = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if network is None:
        return docs.withColumns({lang: F.lit(UNKNOWN), score: F.lit(0.0)})

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = network.pair_tables()
        for texts in batches:
            yield _score(network, tables, texts)

    known, guess = unused([*docs.columns, lang, score], "_readable", "_found")
    found = docs.withColumns({known: readable}).withColumn(guess, run(F.col(text)))
    return found.withColumns(
        {
            lang: F.when(F.col(known), F.col(guess)["lang"]).otherwise(F.lit(UNKNOWN)),
            score: F.when(F.col(known), F.col(guess)["score"]).otherwise(F.lit(0.0)),
        }
    ).drop(known, guess)
