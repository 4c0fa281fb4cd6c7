"""Exact token counts at every prefix of a text, by prefix dynamic programming.

For byte-pair merging the encoding of a prefix ends in exactly one piece that (1) ends where the
prefix ends and (2) may follow the last piece of the remaining, shorter prefix. So the count at a
prefix is the count at that shorter prefix plus one. The counts are stored once and later answer
"how many tokens has this prefix" and "how much text fits a budget" by array lookups.

No piece of the vocabulary continues over the start of a word mark, so the program runs per word
and words seen before are looked up. Every new word's count is checked against the library; should
a vocabulary break the rule, the library encodes each prefix of that word instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

WORD_MARK = "▁"
DEFAULT_MODEL = "piece_bpe_32k.model"
# Words a worker remembers; beyond it the memory is emptied and filled anew (speed only).
REMEMBERED_WORDS = 1_000_000
_CHUNK = re.compile(f"{WORD_MARK}+[^{WORD_MARK}]*")
_workers: dict[str, "PrefixCounter"] = {}


def _resolve(model: str) -> str:
    """A name in the tokenizer folder, or a path as it is."""
    if "/" in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


class PrefixCounter:
    """Prefix counts for one byte-pair sentencepiece model."""

    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(_resolve(model), "rb") as file:
            raw = file.read()
        spec = proto.ModelProto()
        spec.ParseFromString(raw)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        spec.normalizer_spec.add_dummy_prefix = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        ordinary = [p for p in spec.pieces if p.type in (1, 4)]
        if any(WORD_MARK in p.piece.lstrip(WORD_MARK) for p in ordinary):
            raise ValueError("the model has pieces that span words")
        self.pieces = {p.piece for p in ordinary}
        self.beginnings = {p.piece[:n] for p in ordinary for n in range(1, len(p.piece) + 1)}
        self.may_follow: dict[tuple[str, str], bool] = {}
        # Counts by the word without its first mark; bytes where they fit, to save memory.
        self.words: dict[str, bytes | list[int]] = {}
        self.checked_by_library = 0

    def _follows(self, left: str, right: str) -> bool:
        """Whether the encoding of both together is the two pieces themselves."""
        key = (left, right)
        known = self.may_follow.get(key)
        if known is None:
            known = self.plain.encode(left + right, out_type=str) == [left, right]
            self.may_follow[key] = known
        return known

    def _program(self, word: str) -> list[int] | None:
        """Counts for word[:1], word[:2], ...; None if some prefix finds no last piece."""
        n = len(word)
        counts: list[int] = [0] * (n + 1)
        last: list[str | None] = [None] * (n + 1)
        pieces, beginnings, follow = self.pieces, self.beginnings, self.may_follow
        for start in range(n):
            before = last[start]
            if start and not counts[start]:
                return None
            if word[start] not in pieces:
                # A character outside the vocabulary becomes its bytes and never merges.
                counts[start + 1] = counts[start] + len(word[start].encode("utf-8", "replace"))
                last[start + 1] = ""
                continue
            for end in range(start + 1, n + 1):
                piece = word[start:end]
                if piece not in beginnings:
                    break
                if piece in pieces:
                    if before:
                        known = follow.get((before, piece))
                        if known is None:
                            known = self._follows(before, piece)
                        if not known:
                            continue
                    counts[end] = counts[start] + 1
                    last[end] = piece
        return counts[1:] if counts[n] else None

    def learn(self, words: list[str]) -> None:
        """Run the program for new words (each without its first mark)."""
        if len(self.may_follow) > 4 * REMEMBERED_WORDS:
            self.may_follow.clear()
        marked = [WORD_MARK + word for word in words]
        exact = [len(ids) for ids in self.plain.encode(marked, num_threads=1)]
        for word, whole, total in zip(words, marked, exact, strict=True):
            counts = self._program(whole)
            if counts is None or counts[-1] != total:
                self.checked_by_library += 1
                counts = [len(self.plain.encode(whole[:end])) for end in range(1, len(whole) + 1)]
            self.words[word] = bytes(counts) if max(counts) < 256 else counts

    @staticmethod
    def split(text: str) -> list[str]:
        """The words of a text, each without its first mark; in all they spell the marked text."""
        if "  " in text or WORD_MARK in text or text.startswith(" "):
            marked = WORD_MARK + text.replace(" ", WORD_MARK)
            return [chunk[1:] for chunk in _CHUNK.findall(marked)]
        return text.split(" ")

    def prepare(self, texts: list[list[str]]) -> None:
        needed = set().union(*texts)
        new = needed.difference(self.words)
        if len(self.words) + len(new) > REMEMBERED_WORDS:
            self.words.clear()
            new = needed
        if new:
            self.learn(list(new))

    def prefixes(self, text: str, words: list[str]) -> np.ndarray:
        """counts[i] for text[:i]; counts[0] is 0."""
        counts = np.zeros(len(text) + 1, np.int32)
        at, base = -1, 0
        for word in words:
            kept = self.words[word]
            own = np.array(kept if isinstance(kept, list) else np.frombuffer(kept, np.uint8), np.int32)
            begin = max(at + 1, 0)
            counts[begin : at + 1 + len(own)] = own[begin - at - 1 :] + base
            at += len(own)
            base += int(own[-1])
        counts[0] = 0
        return counts

    def total(self, words: list[str]) -> int:
        known = self.words
        return sum([known[word][-1] for word in words])


def _worker(model: str) -> PrefixCounter:
    if model not in _workers:
        _workers[model] = PrefixCounter(model)
    return _workers[model]


def _groups(texts: pd.Series, chars: int = 4_000_000) -> Iterator[list[str]]:
    """The texts of a batch, a bounded number of characters at a time (one text at least)."""
    group: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if group and size + len(text) > chars:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    yield group


def _last_counts(counter: PrefixCounter, texts: pd.Series) -> list[int]:
    out: list[int] = []
    for group in _groups(texts):
        split = [counter.split(text) if text else [] for text in group]
        counter.prepare(split)
        out += [counter.total(words) for words in split]
    return out


def token_counts(
    docs: DataFrame, text: str = "text", model: str = DEFAULT_MODEL, name: str = "n_tokens"
) -> DataFrame:
    """Add the count at the whole text, the last entry of the prefix program.

    Null and empty texts count 0. No row is dropped, added or moved; a column called ``name`` is
    replaced, all others stay. Texts of any length are counted whole.
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _worker(model)
        for texts in batches:
            yield pd.Series(_last_counts(counter, texts), dtype="int64")

    return docs.withColumn(name, count(F.col(text)))


def prefix_counts(
    docs: DataFrame, text: str = "text", model: str = DEFAULT_MODEL, name: str = "prefix_tokens"
) -> DataFrame:
    """Add ``array<int>`` with the count at every prefix: entry i belongs to the first i characters.

    Null and empty texts give ``[0]``.
    """

    @F.pandas_udf("array<int>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _worker(model)
        for texts in batches:
            out: list[np.ndarray] = []
            for group in _groups(texts):
                split = [counter.split(t) if t else [] for t in group]
                counter.prepare(split)
                out += [counter.prefixes(t, w) for t, w in zip(group, split, strict=True)]
            yield pd.Series(out)

    return docs.withColumn(name, count(F.col(text)))


def tokens_at(prefixes: Column | str, chars: Column | int) -> Column:
    """Tokens of the first ``chars`` characters; beyond the end, of the whole text."""
    prefixes = F.col(prefixes) if isinstance(prefixes, str) else prefixes
    chars = F.lit(chars) if isinstance(chars, int) else chars
    at = F.greatest(F.lit(0), F.least(chars, F.size(prefixes) - 1))
    return F.element_at(prefixes, (at + 1).cast("int"))


def longest_prefix(prefixes: Column | str, budget: Column | int) -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens (null for a negative one).

    Counts may fall again when a longer piece forms, so the last fitting entry is taken.
    """
    prefixes = F.col(prefixes) if isinstance(prefixes, str) else prefixes
    budget = F.lit(budget) if isinstance(budget, int) else budget
    fits = F.transform(prefixes, lambda n, i: F.when(n <= budget, i))
    return F.array_max(fits)
