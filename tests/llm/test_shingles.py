"""Hashes of words: the same however many texts are given at once, and bounded in memory."""

import tracemalloc

import numpy as np

from kinfold.llm import shingles as S, suffix_dedup as D


def test_hashes_do_not_depend_on_what_is_hashed_at_once(monkeypatch):
    texts = ["One two  three", None, "", "größe two " * 30, "x" * 90, " ", "two\tONE"]
    hashes, at = S.word_hashes(texts)
    monkeypatch.setattr(S, "HASHED_CHARACTERS", 40)
    again, bounds = S.word_hashes(texts)
    assert hashes.tolist() == again.tolist() and at.tolist() == bounds.tolist()
    assert at.tolist() == [0, 3, 3, 3, 63, 64, 64, 66]
    assert hashes[0] == hashes[65] and hashes[1] == hashes[64]


def test_workers_keep_few_powers(monkeypatch):
    monkeypatch.setattr(S, "_powers", [])
    texts = ["some words of a text " * 100] * 2_000
    tracemalloc.start()
    hashes, _ = S.word_hashes(texts)
    D.Runs([t.encode() for t in texts], D.LENGTH)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(hashes) == 5 * 100 * 2_000
    assert sum(p.nbytes for p in S._powers) <= 16 << 20
    assert peak < 150e6


def test_counters_keep_their_order():
    from kinfold.llm.jaccard import _shortened

    counts = np.array([1, 2, (1 << 15) - 1, 1 << 15, 1 << 20, (1 << 32) - 1], np.uint32)
    short = _shortened(counts).tolist()
    assert short[:4] == counts[:4].tolist() and short == sorted(short) and short[-1] < 1 << 17
