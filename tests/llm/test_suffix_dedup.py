"""Induced sorting against a plain sort, and byte removal against brute force."""

import random

import numpy as np
import pytest

from kinfold.llm import induced as I


def strings(seed):
    rng = random.Random(seed)
    kinds = [
        lambda: bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))),
        lambda: bytes(rng.randrange(256) for _ in range(rng.randint(1, 40))),
        lambda: bytes([rng.choice(b"az")]) * rng.randint(1, 50),
        lambda: b"abcabcabc" * rng.randint(1, 5),
        lambda: b"\x00\xff\x00" * rng.randint(1, 9),
    ]
    return [rng.choice(kinds)() for _ in range(rng.randint(1, 25))]


@pytest.mark.parametrize("limit", [1 << 20, 100])
def test_order_and_prefixes(limit):
    for seed in range(60):
        depth = random.Random(seed).choice([1, 2, 5, 12, 50])
        text, _ = I.join_segments(strings(seed))
        shard = I.Shard(text, depth, limit)
        positions, common = shard.order()
        assert sorted(positions.tolist()) == list(range(len(text) - 1))
        cut = [tuple(text[p : p + depth]) for p in positions]
        assert cut == sorted(cut, reverse=True)
        for k in range(1, len(cut)):
            same = 0
            while same < depth and positions[k - 1] + same < len(text) and positions[k] + same < len(text) and (
                text[positions[k - 1] + same] == text[positions[k] + same]
            ):
                same += 1
            assert common[k] == same, (seed, k)
        if limit == 100 and len(text) > 200:
            assert shard.spilled


def test_window_minima():
    for seed in range(30):
        segments = strings(seed)
        owner = np.array([random.Random(seed + k).randint(-5, 5) for k in range(len(segments))])
        depth = 6
        least = {}
        for s, o in zip(segments, owner, strict=True):
            for i in range(len(s) - depth + 1):
                least[s[i : i + depth]] = min(least.get(s[i : i + depth], 99), o)
        got, starts = I.window_minima(segments, owner, depth)
        for s, at in zip(segments, starts, strict=True):
            for i in range(len(s)):
                want = least[s[i : i + depth]] if i + depth <= len(s) else np.iinfo(np.int64).max
                if at + i < len(got):
                    assert got[at + i] == want


def brute(rows, length):
    """What stays of every text, and how many spans go."""
    first = {}
    for i, t in sorted(((float("inf") if i is None else i), t or b"") for i, t in rows):
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    out = []
    for i, t in rows:
        t, i = t or b"", float("inf") if i is None else i
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), bytes(b for b, g in zip(t, gone, strict=True) if not g), spans))
    return sorted(out)


def documents(seed):
    rng = random.Random(seed)
    prose = lambda n: " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(n))
    shared = [prose(30) for _ in range(4)]
    texts = [None, "", "short", "x" * 500, "x" * 49, "x" * 50, "ab" * 200, "é" * 80]
    for _ in range(40):
        texts.append("\n".join(rng.choice([prose(20), rng.choice(shared), rng.choice(shared)[7:130]]) for _ in range(rng.randint(1, 5))))
    texts += [texts[10], texts[11], texts[10] + texts[11], texts[12][:60] + "~" + texts[12][60:]]
    return texts


@pytest.mark.parametrize("block_bytes", [1 << 24, 3000])
def test_against_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr("kinfold.llm.suffix_dedup.PIECE_BYTES", 700)
    from kinfold.llm import suffix_dedup as S

    texts = documents(block_bytes)
    rows = [(7 * i % 101, t) for i, t in enumerate(texts)] + [(None, texts[9]), (5000, texts[9]), (5000, texts[9])]
    docs = spark.createDataFrame([(t, i, "c", 3) for i, t in rows], "text string, doc_id long, kept string, block int")
    got = S.remove_repeats(docs, block_bytes=block_bytes).collect()
    assert all((r.other.kept, r.other.block) == ("c", 3) for r in got)
    mine = sorted((float("inf") if r.doc_id is None else r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in got)
    assert mine == brute([(i, t and t.encode()) for i, t in rows], 50)
    assert all(r.n_bytes - len(r.kept) == sum(s.end - s.start for s in r.spans) for r in got)


def test_empty_table_and_short_strings(spark):
    from kinfold.llm import suffix_dedup as S

    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(docs).count() == 0
    with pytest.raises(ValueError):
        S.remove_repeats(docs, length=20)


def test_query(spark, sf_small):
    import hashlib

    from kinfold.llm.queries import op1_suffix_array_dedup

    docs = [(r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    want = [(i, n, n - len(k), s, hashlib.sha256(k).hexdigest()) for i, n, k, s in brute(docs, 50)]
    assert sorted(map(tuple, op1_suffix_array_dedup(spark, sf_small).collect())) == want
