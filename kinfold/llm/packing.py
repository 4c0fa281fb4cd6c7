"""Best-fit packing of token sequences by hierarchical residual packing.

Level 0 packs each partition by best fit, longest pieces first. Then bins are merged up a tree as
items: a task takes the underfull bins of a few neighbours and best-fits them again, until one
task's worth is left. A bin leaves the tree as nearly full once no bin elsewhere can need it:
after best fit at most one bin of a group is at most half full, and only such a bin can move into
another, so of the fuller ones a group keeps as many as there are other groups, emptiest first.
What a task reads is bounded by fan-in times the number of groups, whatever the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinfold.llm.names import unused
from kinfold.session import cut

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
# The same vocabulary as ranks: the quicker library, used only where both must agree.
DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
END_ID = 2
SEQUENCE_TOKENS = 1024
ITEMS_PER_PARTITION = 200_000
FAN_IN = 8
SAFE_BLANKS = 50_000
_BLANKS = re.compile(r"\s{%d}" % SAFE_BLANKS)
_encoders: dict[tuple, "Encoder"] = {}


class Encoder:
    """Token ids of a text exactly as the ``tokenizers`` library gives them.

    Texts without special strings go through the rank file of the same vocabulary, if one is
    named. The library itself takes the others, and texts with endless runs of blanks.
    """

    def __init__(self, tokenizer: str, ranks: str | None):
        import public_tokenizers as files
        from tokenizers import Tokenizer

        where = (lambda name: name if "/" in name else files.path(name))
        self.library = Tokenizer.from_file(where(tokenizer))
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.quick = None
        if ranks:
            import base64

            import tiktoken

            with open(where(ranks), "rb") as file:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.quick = tiktoken.Encoding(
                "ranks", pat_str=files.PATTERN, mergeable_ranks=table, special_tokens={}
            )

    def ids(self, text: str) -> list[int]:
        if self.quick and not any(s in text for s in self.special):
            # The quick library's pattern overflows its stack on endless runs of blanks.
            if len(text) <= SAFE_BLANKS or not _BLANKS.search(text):
                return self.quick.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


def _encoder(tokenizer: str, ranks: str | None) -> Encoder:
    key = (tokenizer, ranks)
    if key not in _encoders:
        _encoders[key] = Encoder(tokenizer, ranks)
    return _encoders[key]


def cut_points(tokens: int, size: int) -> list[int]:
    """Where pieces start: whole if it fits, else pieces of ``size`` after a shorter first one."""
    first = tokens % size if tokens > size else 0
    return [0, *range(first, tokens, size)] if first else list(range(0, tokens, size))


def token_pieces(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str = DEFAULT_TOKENIZER,
    ranks: str | None = DEFAULT_RANKS,
    end_id: int = END_ID,
    size: int = SEQUENCE_TOKENS,
) -> DataFrame:
    """(doc_id, piece, start, length, ids): the token ids of every document, cut to fit a sequence.

    ``ids`` are little-endian unsigned 32-bit numbers. Every document ends in ``end_id``, so a null
    or empty text is one piece of one token. Repeated rows and null ids stay rows of their own.
    Other columns are not read.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, ranks)
        for batch in batches:
            rows: list[int] = []
            parts: list[tuple[int, int, int, bytes]] = []
            waiting = 0
            for row, text_value in enumerate(batch.column(1)):
                tokens = [*encoder.ids(text_value.as_py() or ""), end_id]
                ids = np.array(tokens, "<u4")
                starts = cut_points(len(ids), size)
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    rows.append(row)
                    parts.append((piece, a, b - a, ids[a:b].tobytes()))
                waiting += len(ids)
                if waiting > 4_000_000:
                    yield _piece_batch(batch, rows, parts)
                    rows, parts, waiting = [], [], 0
            if parts:
                yield _piece_batch(batch, rows, parts)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        encode, f"doc_id {id_type}, piece int, start long, length long, ids binary"
    )


def _piece_batch(batch: pa.RecordBatch, rows: list[int], parts: list[tuple]) -> pa.RecordBatch:
    piece, start, length, ids = zip(*parts, strict=True)
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(pa.array(rows, pa.int64())),
            pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
            pa.array(length, pa.int64()), pa.array(ids, pa.binary()),
        ],
        ["doc_id", "piece", "start", "length", "ids"],
    )


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of every item, and the fill of every bin; longest items first.

    Open bins lie in stacks by free space; a bit mask finds the tightest stack that still fits.
    """
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    fills: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    open_mask = 0
    for item in np.argsort(-lengths, kind="stable"):
        need = int(lengths[item])
        fitting = open_mask >> need
        if fitting:
            room = need + ((fitting & -fitting).bit_length() - 1)
            chosen = stacks[room].pop()
            if not stacks[room]:
                open_mask &= ~(1 << room)
        else:
            room, chosen = size, len(fills)
            fills.append(0)
        bins[item], offsets[item] = chosen, fills[chosen]
        fills[chosen] += need
        left = room - need
        if left:
            stacks[left].append(chosen)
            open_mask |= 1 << left
    return bins, offsets, fills


def _underfull(fills: np.ndarray, size: int, others: int) -> np.ndarray:
    """Which bins go up the tree: those at most half full, and as many hosts as can be needed."""
    small = np.flatnonzero(2 * fills <= size)
    fuller = np.flatnonzero((2 * fills > size) & (fills < size))
    return np.concatenate([small, fuller[np.argsort(fills[fuller], kind="stable")][:others]])


def best_fit_pack(
    items: DataFrame,
    size: int = SEQUENCE_TOKENS,
    length: str = "length",
    per_partition: int = ITEMS_PER_PARTITION,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``: a place for every row, gapless from 0.

    Every row is one item of 1 to ``size`` tokens; longer ones or null lengths are an error.
    Repeated rows are items of their own; an empty table gives an empty table. Columns of the
    names ``sequence_id`` and ``offset`` are replaced, all others are carried along whatever their
    names.
    """
    own = [c for c in items.columns if c not in ("sequence_id", "offset")]
    (row,) = unused(own, "_row")
    rows = cut(items.select(*own, F.monotonically_increasing_id().alias(row)))
    total, shortest, longest, unknown = rows.agg(
        F.count(F.lit(1)), F.min(length), F.max(length), F.count_if(F.col(length).isNull())
    ).first()
    if unknown or (total and (shortest < 1 or longest > size)):
        raise ValueError(f"items have 1 to {size} tokens")
    groups = max(1, -(-total // per_partition))
    part = F.pmod(F.xxhash64(row), F.lit(groups))

    def pack(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        bins, offsets, fills = best_fit(frame["_length"].to_numpy(), size)
        up = np.zeros(len(fills), bool)
        up[_underfull(np.array(fills), size, groups)] = True
        first = int(keys[0]) << 40
        return pd.DataFrame(
            {
                "_row": frame["_row"], "_bin": first + bins, "offset": offsets,
                "_fill": np.array(fills, np.int64)[bins], "_up": up[bins],
            }
        )

    placed = cut(
        rows.select(F.col(row).alias("_row"), F.col(length).cast("long").alias("_length"), part.alias("_part"))
        .groupBy("_part")
        .applyInPandas(pack, "_row long, _bin long, offset long, _fill long, _up boolean")
    )
    waiting = placed.filter("_up").select("_bin", "_fill").distinct()
    span = 1
    while groups > 1:
        span, groups = span * fan_in, -(-groups // fan_in)
        level = cut(_merge(waiting, size, span, groups))
        moved = level.filter("_bin <> _into").select("_bin", "_into", "_shift")
        placed = (
            placed.join(moved, "_bin", "left")
            .withColumn("offset", F.col("offset") + F.coalesce("_shift", F.lit(0)))
            .withColumn("_bin", F.coalesce("_into", "_bin"))
            .drop("_into", "_shift")
        )
        waiting = level.filter("_up").select(F.col("_into").alias("_bin"), "_fill").distinct()
    numbers = placed.select(F.col("_row").alias(row), F.col("_bin").alias("sequence_id"), "offset")
    return rows.join(numbers, row).drop(row)


def _merge(waiting: DataFrame, size: int, span: int, groups: int) -> DataFrame:
    """One level of the tree: (_bin, _into, _shift, _fill of the new bin, _up).

    A bin's number holds its first partition in the upper bits; ``span`` neighbours make a group.
    """

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_bin", ignore_index=True)
        bins, shifts, fills = best_fit(frame["_fill"].to_numpy(), size)
        names = frame["_bin"].to_numpy()
        hosts = np.empty(len(fills), np.int64)
        hosts[bins[shifts == 0]] = names[shifts == 0]
        up = np.zeros(len(fills), bool)
        up[_underfull(np.array(fills), size, groups)] = True
        return pd.DataFrame(
            {
                "_bin": names, "_into": hosts[bins], "_shift": shifts,
                "_fill": np.array(fills, np.int64)[bins], "_up": up[bins],
            }
        )

    group = F.expr(f"shiftright(_bin, 40) div {span}")
    return (
        waiting.withColumn("_group", group)
        .groupBy("_group")
        .applyInPandas(merge, "_bin long, _into long, _shift long, _fill long, _up boolean")
    )
