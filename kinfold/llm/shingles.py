"""Word and shingle hashes of many texts at once, in numpy.

Words are runs of bytes other than blank, tab, newline, vertical tab, form feed and return, with
A-Z lowered. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(b"\x20\x09\x0a\x0b\x0c\x0d")] = False
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []
# Characters of texts that are hashed at once: arrays over their bytes, and powers that a worker
# keeps, follow this number and not what a caller holds.
HASHED_CHARACTERS = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def groups(texts: Iterable, size: int = 4_000_000) -> Iterator[list]:
    """A bounded number of characters at a time; a longer text is a group of its own."""
    group: list = []
    held = 0
    for text in texts:
        length = len(text) if text else 0
        if group and held + length > size:
            yield group
            group, held = [], 0
        group.append(text)
        held += length
    if group:
        yield group


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64; at least ``n`` of them."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def word_spans(data: bytes, letters: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word, a run of bytes marked in ``letters``."""
    inside = letters[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edges[::2], edges[1::2]


def word_hashes(texts: list[str | None], letters: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (one entry more)."""
    hashes, bounds = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for group in groups(texts, HASHED_CHARACTERS):
        found, at = _hashes_at_once(group, letters)
        hashes.append(found)
        bounds.append(at[1:] + bounds[-1][-1])
    return np.concatenate(hashes), np.concatenate(bounds)


def _hashes_at_once(texts: list[str | None], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    encoded = [(t or "").encode("utf-8", "replace").translate(_LOWER) for t in texts]
    data = b" ".join(encoded)
    starts, ends = word_spans(data, letters)
    up, down = _power(len(data) + 1)
    raw = np.frombuffer(data, np.uint8)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    at = np.cumsum([0, *(len(e) + 1 for e in encoded)])
    return hashes, np.searchsorted(starts, at)


def rolled_hashes(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hashes of ``words`` neighbouring words each, also across texts."""
    count = max(len(hashes) - words + 1, 0)
    rolled = np.zeros(count, np.uint64)
    for j in range(words):
        rolled += hashes[j : j + count] * _PLACE[j]
    return mix(rolled)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text.

    With fewer words the whole sequence is the one shingle; without words the set is empty.
    """
    hashes, bounds = word_hashes(texts)
    rolled = rolled_hashes(hashes, words)
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            sets.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            short = (hashes[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + _PLACE[63 - (b - a)]
            sets.append(mix(np.array([short], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set of hashes, as two signed longs."""
    first = mix(values).sum(dtype=np.uint64)
    second = mix(values ^ _PLACE[62]).sum(dtype=np.uint64)
    return int(first.astype(np.int64)), int(second.astype(np.int64))
