"""Removal of repeated byte strings over a whole corpus, by suffix arrays of shards.

A window (string of ``length`` bytes) is named by the smallest hash among its inner strings, so
equal windows have one name wherever they stand, and neighbouring windows mostly share theirs.

1. Documents are dealt into blocks of bounded size, written once as a bucketed table.
2. Each block tells every name it holds, once; names held by two documents are shared.
3. Each block cuts the stretches of windows with shared names into segments, drops repeats of a
   segment within the block, and sends them to the shard of their name.
4. A shard sorts its segments by external induced sorting (``induced.py``) and finds for every
   window the smallest document that has it. A segment that is alone under its name needs no
   sorting: no other has its windows. Each block gets back what its own segments need.
5. Each block marks the bytes and cuts them out.

Blocks and shards grow in number, not in size. A name, however frequent, reaches its shard at most
once from each block, and a copied segment is sorted once.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from kinfold.llm.induced import window_minima
from kinfold.llm.shingles import _BYTE, _power, mix
from kinfold.session import shared_folder

LENGTH = 50
# Bytes of a string whose hash may name a window; 24 bytes of prose are rarely shared by chance.
NAME_BYTES = 24
BLOCK_BYTES = 16 << 20
# Shards for each block: what one task sorts at a time is a fraction of what one block holds.
SHARDS_PER_BLOCK = 4
# Bytes that are hashed at once; with their gaps they stay below a power of two, as a worker keeps as many powers.
PIECE_BYTES = (1 << 19) - (1 << 13)
_NAME_MASK = np.uint64((1 << 48) - 1)
_MULTIPLIERS = [np.uint64(x | 1) for x in (0x8CB92BA72F3D8DD6, 0xA24BAED4963EE406, 0xD1B54A32D192ED02)]
_LAST_ID = np.iinfo(np.int64).max


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    least = values
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    extra = width - reach
    return np.minimum(least[: len(least) - extra], least[extra:]) if extra else least


def _names(data: np.ndarray, length: int) -> np.ndarray:
    """The name of every window of ``data``."""
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    count = len(data) - NAME_BYTES + 1
    hashes = np.zeros(count, np.uint64)
    for k, m in enumerate(_MULTIPLIERS):
        hashes += words[8 * k : 8 * k + count] * m
    hashes = mix(hashes)
    return _sliding_minimum(hashes, length - NAME_BYTES + 1) & _NAME_MASK


class Runs:
    """Maximal stretches of windows with one name, for all documents of a block."""

    def __init__(self, datas: list[bytes], length: int, wanted: np.ndarray | None = None):
        self.datas = datas
        columns: list[tuple] = []
        for numbers, offsets, data, bounds in self._pieces(datas, length):
            raw = np.frombuffer(data, np.uint8)
            names = _names(raw, length)[: bounds[-1]]
            # Windows that lie in one document; each piece ends in its own gap.
            piece = np.repeat(np.arange(len(numbers)), np.diff(bounds))
            place = np.arange(len(names)) - bounds[:-1][piece]
            sizes = np.diff(bounds) - 1
            inside = place + length <= sizes[piece]
            head = inside.copy()
            head[1:] &= (names[1:] != names[:-1]) | ~inside[:-1]
            tail = inside.copy()
            tail[:-1] &= (names[1:] != names[:-1]) | ~inside[1:]
            begin, end = np.flatnonzero(head), np.flatnonzero(tail) + length
            own = names[begin]
            if wanted is not None:
                at = np.searchsorted(wanted, own)
                hit = np.zeros(len(own), bool)
                near = at < len(wanted)
                hit[near] = wanted[at[near]] == own[near]
                begin, end, own = begin[hit], end[hit], own[hit]
            if len(begin):
                up, down = _power(len(raw) + 1)
                sums = np.zeros(len(raw) + 1, np.uint64)
                np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
                print_ = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
                which = piece[begin]
                columns.append((own, print_, np.array(numbers)[which], np.array(offsets)[which] + place[begin], end - begin))
        parts = list(zip(*columns, strict=True)) if columns else [[]] * 5
        kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64)
        self.name, self.print, self.doc, self.start, self.size = (
            np.concatenate(p) if len(p) else np.zeros(0, k) for p, k in zip(parts, kinds, strict=True)
        )

    @staticmethod
    def _pieces(datas: list[bytes], length: int) -> Iterator[tuple]:
        """Documents joined up to ``PIECE_BYTES``; longer ones in pieces that share length-1 bytes."""
        numbers, offsets, held, size = [], [], [], 0

        def out() -> tuple:
            bounds = np.cumsum([0, *(len(h) + 1 for h in held)])
            return numbers, offsets, b"\0".join(held) + b"\0" * (length + 8), bounds

        for number, data in enumerate(datas):
            for at in range(0, max(len(data) - length + 1, 0), PIECE_BYTES):
                part = data[at : at + PIECE_BYTES + length - 1]
                if held and size + len(part) > PIECE_BYTES:
                    yield out()
                    numbers, offsets, held, size = [], [], [], 0
                numbers.append(number)
                offsets.append(at)
                held.append(part)
                size += len(part)
        if held:
            yield out()

    def bytes_of(self, run: int) -> bytes:
        at = int(self.start[run])
        return self.datas[self.doc[run]][at : at + int(self.size[run])]


def _pack(names: np.ndarray, parts: int) -> bytes:
    """48-bit names of one part: the part is their remainder, so only quotients are written.

    The first byte says how many bytes each takes.
    """
    width = (((1 << 48) - 1) // parts).bit_length() + 7 >> 3
    quotients = np.ascontiguousarray(names // np.uint64(parts), "<u8")
    return bytes([width]) + quotients.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: bytes, part: int, parts: int) -> np.ndarray:
    width = blob[0]
    raw = np.zeros(((len(blob) - 1) // width, 8), np.uint8)
    raw[:, :width] = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    return raw.view("<u8").ravel() * np.uint64(parts) + np.uint64(part)


def _squeeze(values: np.ndarray, kind: str) -> bytes:
    """A column of numbers as bytes that travel well."""
    return zlib.compress(values.astype(kind).tobytes(), 1)


def _expand(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), kind)


def _by_part(names: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each part of the name space that has any."""
    part = (names % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(part[rows[0]]), rows


def _tell_names(frame: pd.DataFrame, length: int, parts: int) -> pd.DataFrame:
    runs = Runs(frame["data"].tolist(), length)
    return tell(runs.name, runs.doc, int(frame["block"].iloc[0]), parts)


def tell(name: np.ndarray, doc: np.ndarray, block: int, parts: int) -> pd.DataFrame:
    """Each name of a block once: first those of two of its documents, ``many`` of them."""
    order = np.lexsort((doc, name))
    name, doc = name[order], doc[order]
    head = np.ones(len(name), bool)
    head[1:] = name[1:] != name[:-1]
    group = np.cumsum(head) - 1
    other = np.zeros(len(name), bool)
    other[1:] = (doc[1:] != doc[:-1]) & ~head[1:]
    many = np.bincount(group[other], minlength=head.sum()) > 0
    name = name[head]
    rows = []
    for part, at in _by_part(name, parts):
        twice = many[at]
        rows.append((part, block, int(twice.sum()), _pack(np.concatenate([name[at][twice], name[at][~twice]]), parts)))
    return pd.DataFrame(rows, columns=["part", "block", "many", "names"])


def share_names(frame: pd.DataFrame, parts: int) -> pd.DataFrame:
    """For each block the names that another block holds too, or two of its documents."""
    part = int(frame["part"].iloc[0])
    lists = [unpack(b, part, parts) for b in frame["names"]]
    every = np.sort(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    rows = []
    for names, block, many in zip(lists, frame["block"], frame["many"], strict=True):
        shared = np.isin(names, twice)
        shared[:many] = True
        if shared.any():
            rows.append((block, part, _pack(names[shared], parts)))
    return pd.DataFrame(rows, columns=["block", "part", "names"])


def shared_names(frame: pd.DataFrame, parts: int) -> np.ndarray:
    """All shared names of a block, sorted."""
    return np.sort(np.concatenate([unpack(b, p, parts) for b, p in zip(frame["names"], frame["part"], strict=True)]))


def row_ids(frame: pd.DataFrame) -> np.ndarray:
    """Ids of a block's documents; a missing id comes after all others."""
    return np.array([_LAST_ID if pd.isna(i) else int(i) for i in frame["id"]], np.int64)


def _cut_segments(docs: pd.DataFrame, shared: pd.DataFrame, length: int, parts: int) -> pd.DataFrame:
    """Distinct segments of a block by shard, with the smallest and largest id that has each."""
    columns = ["part", "block", "prints", "names", "sizes", "lows", "spreads", "data"]
    if not len(shared) or not len(docs):
        return pd.DataFrame(columns=columns)
    wanted = shared_names(shared, parts)
    runs = Runs(docs["data"].tolist(), length, wanted)
    if not len(runs.name):
        return pd.DataFrame(columns=columns)
    ids = row_ids(docs)[runs.doc]
    order = np.lexsort((runs.print, runs.name))
    name, print_, ids = runs.name[order], runs.print[order], ids[order]
    head = np.ones(len(name), bool)
    head[1:] = (name[1:] != name[:-1]) | (print_[1:] != print_[:-1])
    at = np.flatnonzero(head)
    low, high = np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at)
    first, name, print_ = order[at], name[at], print_[at]
    block = int(docs["block"].iloc[0])
    rows = []
    for part, own in _by_part(name, parts):
        rows.append(
            (part, block, print_[own].tobytes(), _pack(name[own], parts), _squeeze(runs.size[first[own]], "<u4"),
             _squeeze(low[own], "<i8"), _squeeze(high[own] - low[own], "<i8"),
             zlib.compress(b"".join(runs.bytes_of(r) for r in first[own]), 1))
        )
    return pd.DataFrame(rows, columns=columns)


def _is_single(names: np.ndarray) -> np.ndarray:
    """Which names stand there once."""
    _, place, count = np.unique(names, return_inverse=True, return_counts=True)
    return count[place] == 1


def _ranges(
    segments: list[bytes], lows: np.ndarray, alone: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, smallest id, segment) of windows with one smallest id, by segment.

    Equal windows have equal names, so the windows of a segment that is ``alone`` under its name
    stand in no other: its own smallest id is theirs. All other segments are sorted.
    """
    sizes = np.array([len(s) for s in segments], np.int64)
    known = np.flatnonzero(alone & (lows != _LAST_ID))
    found = [(np.zeros(len(known), np.int64), sizes[known] - length + 1, lows[known], known)]
    sorted_ = np.flatnonzero(~alone)
    if len(sorted_):
        least, starts = window_minima([segments[k] for k in sorted_], lows[sorted_], length)
        new = np.ones(len(least), bool)
        new[1:] = least[1:] != least[:-1]
        new[starts] = True
        begin = np.flatnonzero(new)
        value, span = least[begin], np.diff(begin, append=len(least))
        of = np.searchsorted(starts, begin, "right") - 1
        real = (value != _LAST_ID) & (begin - starts[of] + length <= sizes[sorted_[of]])
        found.append((begin[real] - starts[of[real]], span[real], value[real], sorted_[of[real]]))
    begin, span, value, segment = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(segment, kind="stable")
    return begin[order], span[order], value[order], segment[order]


def _sort_shard(frame: pd.DataFrame, length: int, parts: int) -> pd.DataFrame:
    """For each block: (name, print) of segments, and in them ranges of windows to be removed.

    ``ranges`` holds (segment, first window, windows, smallest id) by number of the block's list.
    """
    part = int(frame["part"].iloc[0])
    known: dict[tuple[int, int], int] = {}
    segments: list[bytes] = []
    lows: list[int] = []
    senders = []
    for row in frame.sort_values("block").itertuples(index=False):
        names, prints = unpack(row.names, row.part, parts), np.frombuffer(row.prints, "<u8")
        sizes, low, data = _expand(row.sizes, "<u4"), _expand(row.lows, "<i8"), zlib.decompress(row.data)
        number = np.empty(len(names), np.int64)
        at = 0
        for k, (key, size, least) in enumerate(zip(zip(names.tolist(), prints.tolist(), strict=True), sizes.tolist(), low.tolist(), strict=True)):
            place = known.setdefault(key, len(segments))
            if place == len(segments):
                segments.append(data[at : at + size])
                lows.append(least)
            elif least < lows[place]:
                lows[place] = least
            number[k] = place
            at += size
        senders.append((row.block, names, prints, low + _expand(row.spreads, "<i8"), number))
    alone = _is_single(np.array([name for name, _ in known], np.uint64))
    del data, known
    begin, span, value, segment = _ranges(segments, np.array(lows, np.int64), alone, length)
    first = np.searchsorted(segment, np.arange(len(segments) + 1))
    smallest = np.full(len(segments), _LAST_ID)
    np.minimum.at(smallest, segment, value)
    rows = []
    for block, names, prints, highs, number in senders:
        removable = np.flatnonzero(smallest[number] < highs)
        if not len(removable):
            continue
        own = number[removable]
        counts = first[own + 1] - first[own]
        pick = np.repeat(first[own] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        ranges = np.stack([np.repeat(np.arange(len(own)), counts), begin[pick], span[pick], value[pick]])
        rows.append((block, part, _pack(names[removable], parts), prints[removable].tobytes(), _squeeze(ranges, "<i8")))
    return pd.DataFrame(rows, columns=["block", "part", "names", "prints", "ranges"])


def _remove(docs: pd.DataFrame, found: pd.DataFrame, length: int, parts: int) -> tuple[list[bytes], list[list[dict]]]:
    """Bytes that stay, and the removed spans, for every document of a block."""
    datas = docs["data"].tolist()
    changes = {}
    if len(found):
        names, prints, tables, base = [], [], [], 0
        for row in found.itertuples(index=False):
            own = unpack(row.names, row.part, parts)
            table = _expand(row.ranges, "<i8").reshape(4, -1).copy()
            table[0] += base
            base += len(own)
            names.append(own)
            prints.append(np.frombuffer(row.prints, "<u8"))
            tables.append(table)
        names, prints, table = np.concatenate(names), np.concatenate(prints), np.concatenate(tables, 1)
        runs = Runs(datas, length, np.unique(names))
        # Join runs and segments on (name, print) by one sort of both.
        all_names = np.concatenate([names, runs.name])
        all_prints = np.concatenate([prints, runs.print])
        order = np.lexsort((np.arange(len(all_names)) >= len(names), all_prints, all_names))
        is_segment = order < len(names)
        last = np.maximum.accumulate(np.where(is_segment, np.arange(len(order)), -1))
        of = order[np.maximum(last, 0)]
        hit = ~is_segment & (last >= 0) & (all_names[of] == all_names[order]) & (all_prints[of] == all_prints[order])
        run, segment = order[hit] - len(names), of[hit]
        by_segment = np.argsort(table[0], kind="stable")
        table = table[:, by_segment]
        first = np.searchsorted(table[0], np.arange(base + 1))
        counts = first[segment + 1] - first[segment]
        pick = np.repeat(first[segment] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        run = np.repeat(run, counts)
        earlier = table[3][pick] < row_ids(docs)[runs.doc[run]]
        run, pick = run[earlier], pick[earlier]
        doc, begin = runs.doc[run], runs.start[run] + table[1][pick]
        end = begin + table[2][pick] - 1 + length
        order = np.argsort(doc, kind="stable")
        cuts = np.flatnonzero(np.diff(doc[order])) + 1
        changes = {int(doc[rows[0]]): (begin[rows], end[rows]) for rows in np.split(order, cuts) if len(rows)}
    kept, spans = [], []
    for number, data in enumerate(datas):
        if number not in changes:
            kept.append(data)
            spans.append([])
            continue
        begin, end = changes[number]
        steps = np.bincount(begin, minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1)
        gone = np.cumsum(steps)[: len(data)] > 0
        kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
        edges = np.flatnonzero(np.diff(gone, prepend=False, append=False)).tolist()
        spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
    return kept, spans


def block_table(docs: DataFrame, doc_id: str, text: str, block_bytes: int) -> tuple[DataFrame, int]:
    """``docs`` as (id, data, other, row, block), written once and bucketed by block.

    Each partition is dealt into blocks of ``block_bytes`` at most, about; nothing is shuffled, here
    or later when the table is grouped by block. The second value is how many such blocks there
    would be if all were full: what the number of shards follows.
    """
    spark = docs.sparkSession
    others = [F.col(c) for c in docs.columns if c not in (text, doc_id)]
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    sizes = docs.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length(text)).alias("bytes"))
    total, largest, pieces = sizes.agg(F.sum("bytes"), F.max("bytes"), F.count(F.lit(1))).first()
    split = max(1, -(-(largest or 0) // block_bytes))
    blocks = max(pieces * split, int(spark.conf.get("spark.sql.shuffle.partitions")))
    row = F.monotonically_increasing_id()
    rows = docs.select(
        F.col(doc_id).cast("long").alias("id"), data.alias("data"),
        F.struct(*(others or [F.lit(None).cast("int").alias("_")])).alias("other"), row.alias("row"),
    ).withColumn("block", (F.spark_partition_id() * split + F.pmod(F.xxhash64("row"), F.lit(split))).cast("int"))
    name = f"kinfold_blocks_{uuid.uuid4().hex}"
    (
        rows.write.bucketBy(blocks, "block").option("path", f"{shared_folder(spark).rstrip('/')}/{name}")
        .option("compression", "zstd").saveAsTable(name)
    )
    # Joins on block and row may then keep the table where its buckets are.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    blocks = max(1, -(-(total or 0) // block_bytes))
    return spark.table(name), blocks


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, n_bytes, kept, spans, other) for every row of ``docs``.

    Removed is every byte covered by a string of ``length`` bytes that also starts in a document
    with a smaller id. Strings are judged on the input and never cross documents. ``kept`` are the
    remaining bytes, ``spans`` the maximal removed runs (start, end) in bytes, ``other`` a struct of
    all other columns under their names. Null texts count as empty. Rows that share an id take
    nothing from each other; a null id counts as larger than all others. ``length`` is 32 at least.
    """
    if length < NAME_BYTES + 8:
        raise ValueError(f"strings have {NAME_BYTES + 8} bytes or more")
    table, blocks = block_table(docs, doc_id, text, block_bytes)
    slim = table.select("id", "data", "block")
    parts = SHARDS_PER_BLOCK * blocks

    told = slim.select("data", "block").groupBy("block").applyInPandas(
        lambda frame: _tell_names(frame, length, parts), "part int, block int, many int, names binary"
    )
    shared = told.groupBy("part").applyInPandas(lambda frame: share_names(frame, parts), "block int, part int, names binary")
    segments = (
        slim.groupBy("block").cogroup(shared.groupBy("block"))
        .applyInPandas(
            lambda a, b: _cut_segments(a, b, length, parts),
            "part int, block int, prints binary, names binary, sizes binary, lows binary, spreads binary, data binary",
        )
    )
    found = segments.groupBy("part").applyInPandas(
        lambda frame: _sort_shard(frame, length, parts), "block int, part int, names binary, prints binary, ranges binary"
    )
    other = table.schema["other"].dataType
    schema = StructType(
        [
            StructField("doc_id", LongType()), StructField("n_bytes", LongType()), StructField("kept", BinaryType()),
            StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))),
            StructField("other", other),
        ]
    )

    def clean(left: pa.Table, right: pa.Table) -> pa.Table:
        """All columns of a block stay where they are; only the texts change."""
        docs = left.select(["id", "data"]).to_pandas(integer_object_nulls=True)
        kept, spans = _remove(docs, right.to_pandas(), length, parts)
        pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table(
            {
                "doc_id": left.column("id"), "n_bytes": pa.array([len(d) for d in docs["data"]], pa.int64()),
                "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pair), "other": left.column("other"),
            }
        )

    whole = table.select("id", "data", "other", "block").groupBy("block")
    return whole.cogroup(found.groupBy("block")).applyInArrow(clean, schema)
