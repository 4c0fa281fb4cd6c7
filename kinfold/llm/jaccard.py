"""N-gram Jaccard join of whole texts, as components, by a grouped prefix join.

1. Each text becomes its set of distinct shingles. Documents with the same set are one class.
2. Shingles are ordered rarest first, by counters that grow in number with the bytes of the corpus
   and lie in slices over the tasks: blocks of texts ask, slices add up and answer. Two sets can
   only reach the similarity if their prefixes (the first n - ceil(t n) + 1 shingles) meet; any
   order that all sets share is exact. A shingle whose counter only one set uses meets nobody.
3. Classes of the same size and the same prefix are one group, and only groups are joined: by a
   shared prefix shingle, the size bound, and the bound on what can still overlap after it.
4. Group pairs are expanded to their members, and every pair is verified on the texts.

The result is components, so a pair within one component need not be verified. A first round
compares each group with two others only, the smallest and the largest holder that it meets most
often, which joins the copies of one text in linear work. It is repeated with holders in the
first and last component of each shingle, while that still joins many, so a large group of near
copies is one component before pairs are taken. The second round takes every remaining pair of holders that lie in different components, without forming pairs inside the largest
component of a shingle. A pair leaves that join at the first shingle it shares, as a rule once: a
holder brings the few shingles before its own, and a pair that has met at one of them is not told
again. Parities of whole sets, where a group is a single set, hold off pairs that differ too much.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from kinfold.llm.names import unused
from kinfold.llm.shingles import digest, groups, shingle_sets
from kinfold.operators.components import connected_components
from kinfold.session import cut, discard

# Counters of one slice of the frequency table, and bytes of text for which there is one slice: at
# six bytes a word a counter stands for a sixth of a shingle, however large the corpus.
SLICE_BITS = 24
SLICE_BYTES = 1 << 24
# Shingles that a block asks of a slice at least, on average, so that rows stay worth their keys.
ASKED = 64
# Bits of a set's parity map, and shingles before its own that a posting carries in the second round.
PARITY_BITS = 512
BEFORE = 8
# The first round is repeated while at least this share of its pairs link, but no more often than this;
# the second one takes all pairs that are left.
WORTH_A_ROUND = 0.5
MOST_ROUNDS = 3

_MEASURED = pa.schema(
    [("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
     ("block", pa.int64()), ("slice", pa.int64()), ("size", pa.int32()), ("data", pa.binary())]
)
_DOCUMENT, _BLOCK, _REQUEST = range(3)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32 byte plane by byte plane, compressed: small ones take little."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes), "zstd", asbytes=True)


def _unpack(data: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * count, "zstd", asbytes=True), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _rows(**columns: object) -> pa.RecordBatch:
    """A batch of ``_MEASURED`` with the given columns, the rest null."""
    size = len(columns["kind"])
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _MEASURED],
        schema=_MEASURED,
    )


def _slices(docs: DataFrame) -> int:
    """Slices of the frequency table: a power of two that grows with the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return 1 << (max(1, -(-size // SLICE_BYTES)) - 1).bit_length()


def _slots(hashes: np.ndarray, slices: int) -> np.ndarray:
    """The counter of every hash: slices follow each other in the order of hashes."""
    return hashes >> np.uint64(64 - SLICE_BITS - slices.bit_length() + 1)


def _measure(docs: DataFrame, words: int, least: int | None, slices: int) -> DataFrame:
    """Rows of three kinds.

    A document has (doc_id, n, d1, d2). A block holds texts of at least ``least`` shingles in a
    row, once if their sets agree; it asks each slice in a row how often its counters are used.
    """

    def block_rows(block: int, held: dict) -> Iterator[pa.RecordBatch]:
        columns = zip(*((i, *key, text) for key, (i, text, _) in held.items()), strict=True)
        table = pa.table(dict(zip(("doc_id", "n", "d1", "d2", "text"), map(list, columns), strict=True)))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        yield _rows(kind=[_BLOCK], block=[block], data=[sink.getvalue().to_pybytes()])
        asked, times = np.unique(np.concatenate([s for _, _, s in held.values()]), return_counts=True)
        numbers = (asked >> np.uint64(SLICE_BITS)).astype(np.int64)
        names, starts = np.unique(numbers, return_index=True)
        parts = [
            (_pack(np.concatenate([np.diff(own & np.uint64((1 << SLICE_BITS) - 1), prepend=np.uint64(0)), many])), len(own))
            for own, many in zip(np.split(asked, starts[1:]), np.split(times.astype(np.uint64), starts[1:]), strict=True)
        ]
        data, size = zip(*parts, strict=True)
        yield _rows(kind=[_REQUEST] * len(names), block=[block] * len(names), slice=names, size=size, data=data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: dict[tuple, tuple] = {}
        asked = 0
        for batch in batches:
            ids = iter(batch.column(0).to_pylist())
            for group in groups(v.as_py() for v in batch.column(1)):
                sets = shingle_sets(group, words)
                keys = [(len(s), *digest(s)) for s in sets]
                own = [next(ids) for _ in group]
                n, d1, d2 = zip(*keys, strict=True)
                yield _rows(kind=[_DOCUMENT] * len(own), doc_id=own, n=n, d1=d1, d2=d2)
                for i, text, key, s in zip(own, group, keys, sets, strict=True):
                    if i is None or least is None or len(s) < least:
                        continue
                    first = held.get(key)
                    if first is None:
                        asked += len(s)
                        held[key] = (i, text, _slots(s, slices))
                    elif i < first[0]:
                        held[key] = (i, text, first[2])
                if held and asked >= ASKED * slices:
                    yield from block_rows(block, held)
                    block, held, asked = block + 1, {}, 0
        if held:
            yield from block_rows(block, held)

    return docs.mapInArrow(run, "kind int, doc_id long, n long, d1 long, d2 long, block long, slice long, size int, data binary")


def _shortened(counts: np.ndarray) -> np.ndarray:
    """Numbers beyond 2**15 by their logarithm; all stay in order."""
    logs = (1024 * (np.log2(np.maximum(counts, 1 << 15)) - 15)).astype(np.uint32)
    return np.where(counts >= 1 << 15, (1 << 15) + logs, counts)


def _answers(measured: DataFrame) -> DataFrame:
    """(block, slice, size, data): for every request how many documents use each counter.

    A slice has a fixed number of counters and gets each block once.
    """

    def count(asked: pa.Table) -> pa.Table:
        counts = np.zeros(1 << SLICE_BITS, np.uint32)
        slots = []
        for size, data in zip(asked["size"].to_pylist(), asked["data"], strict=True):
            deltas, times = np.split(_unpack(data.as_py(), 2 * size), 2)
            slots.append(np.cumsum(deltas, dtype=np.int64))
            counts[slots[-1]] += times
        data = pa.array([_pack(_shortened(counts[s])) for s in slots], pa.binary())
        return asked.select(["block", "slice", "size"]).append_column("data", data)

    requests = measured.filter(F.col("kind") == _REQUEST).select("block", "slice", "size", "data")
    return requests.groupBy("slice").applyInArrow(count, "block long, slice long, size int, data binary")


def _bitmap(tokens: np.ndarray) -> list[int]:
    """256 bits, one set for each token: a bit that another prefix lacks is a token it lacks."""
    marks = np.zeros(256, np.uint8)
    marks[tokens & 255] = 1
    return np.packbits(marks).view("<i8").tolist()


def _parity(values: np.ndarray) -> list[int]:
    """Whether an odd number of hashes falls on each of 512 bits.

    Two sets differ in at least as many hashes as their maps do in bits.
    """
    odd = np.bincount((values & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").tolist()


def _can_agree(n: str, m: str, x: str, y: str, num: int, den: int) -> Column:
    """Whether sets of n and m hashes with parity maps x and y can link; a null map says nothing."""
    differ = sum((F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(PARITY_BITS // 64)), F.lit(0))
    within = (num + den) * differ <= (den - num) * (F.col(n) + F.col(m))
    return F.coalesce(within, F.lit(True))


def _can_share(num: int, den: int) -> Column:
    """Whether two prefixes (n, size, bits) and (n_, size_, bits_) can share enough, by their bits."""
    lacks, lacks_ = (
        sum((F.bit_count(F.col(a)[k].bitwiseAND(F.bitwise_not(F.col(b)[k]))) for k in range(4)), F.lit(0))
        for a, b in (("bits", "bits_"), ("bits_", "bits"))
    )
    both = F.least(F.col("size") - lacks, F.col("size_") - lacks_)
    rest = F.greatest(F.col("n") - F.col("size"), F.col("n_") - F.col("size_"))
    return (num + den) * (both + rest) >= num * (F.col("n") + F.col("n_"))


def _prefixes(measured: DataFrame, words: int, num: int, den: int, slices: int) -> DataFrame:
    """(doc_id, n, d1, d2, size, places, tokens, p1, p2, bits, whole): prefixes of sets that can link.

    A prefix has ``size`` shingles. ``tokens`` are those whose counter somebody else uses as well,
    at ``places`` (from 0); a set without any has no row, since it meets nobody.
    """
    fields = [
        ("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("size", pa.int64()),
        ("places", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int64())), ("p1", pa.int64()), ("p2", pa.int64()),
        ("bits", pa.list_(pa.int64())), ("whole", pa.list_(pa.int64())),
    ]

    def choose(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        held = pa.ipc.open_stream(blocks["data"][0].as_py()).read_all()
        parts = sorted(zip(*(answers[c].to_pylist() for c in ("slice", "size", "data")), strict=True))
        counts = np.concatenate([_unpack(data, size) for _, size, data in parts])
        sets = [s for group in groups(v.as_py() for v in held["text"]) for s in shingle_sets(group, words)]
        _, used = np.unique(_slots(np.concatenate(sets), slices), return_inverse=True)
        counts = np.split(counts[used], np.cumsum([len(s) for s in sets])[:-1])
        found = []
        keys = zip(*(held[c].to_pylist() for c in ("doc_id", "n", "d1", "d2")), strict=True)
        for key, s, own in zip(keys, sets, counts, strict=True):
            order = np.lexsort((s, own))[: len(s) + num * len(s) // -den + 1]
            tokens = s[order]
            places = np.flatnonzero(own[order] > 1)
            if len(places):
                own_tokens = tokens[places].astype(np.int64)
                found.append((*key, len(tokens), places, own_tokens, *digest(tokens), _bitmap(tokens), _parity(s)))
        columns = zip(*found, strict=True) if found else [[] for _ in fields]
        return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])

    blocks = measured.filter(F.col("kind") == _BLOCK).select("block", "data")
    return blocks.groupBy("block").cogroup(_answers(measured).groupBy("block")).applyInArrow(
        choose,
        "doc_id long, n long, d1 long, d2 long, size long, places array<int>, tokens array<long>, p1 long, p2 long, bits array<long>, whole array<long>",
    )


def _can_reach(n: str, m: str, i: str, j: str, num: int, den: int) -> Column:
    """Size bound, and room after places i and j (from 0) for all that must be shared.

    The first shared token of a pair that links always passes: nothing before it is shared.
    """
    n, m, i, j = (F.col(x) for x in (n, m, i, j))
    sizes = (den * F.least(n, m)) >= (num * F.greatest(n, m))
    return sizes & ((num + den) * F.least(n - i, m - j) >= num * (n + m))


def _mixed(entries: DataFrame) -> DataFrame:
    """``entries`` of tokens held in several components, with the one that holds most (``major``)."""
    sizes = entries.groupBy("kind", "token", "c").agg(F.count(F.lit(1)).alias("_n"))
    mixed = (
        sizes.groupBy("kind", "token")
        .agg(F.min("c").alias("_a"), F.max("c").alias("_b"), F.max_by("c", F.struct("_n", "c")).alias("major"))
        .filter("_a <> _b").drop("_a", "_b")
    )
    return entries.join(mixed, ["kind", "token"])


def _hooks(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (g, g1, c, g_, g1_, c_): each holder with two others at most, in other components.

    These are the holders in the first and the last component of its tokens that it meets most
    often. Some links are found so, the rest by ``_meetings``.
    """
    name, facts = F.struct("c", "g", "g1"), F.struct("n", "pos", "whole")
    ends = entries.groupBy("kind", "token").agg(
        F.min(name).alias("low"), F.min_by(facts, name).alias("low_facts"),
        F.max(name).alias("high"), F.max_by(facts, name).alias("high_facts"),
    )
    met = entries.join(ends, ["kind", "token"])
    found = []
    for end in ("low", "high"):
        often = (
            met.filter(F.col("c") != F.col(f"{end}.c"))
            .filter(_can_reach("n", f"{end}_facts.n", "pos", f"{end}_facts.pos", num, den))
            .filter(_can_agree("n", f"{end}_facts.n", "whole", f"{end}_facts.whole", num, den))
            .groupBy("g", "g1", "c", F.col(end).alias("e")).agg(F.count(F.lit(1)).alias("_c"))
            .groupBy("g", "g1", "c").agg(F.max_by("e", F.struct("_c", "e")).alias("e"))
        )
        found.append(often.select("g", "g1", "c", *(F.col(f"e.{x}").alias(f"{x}_") for x in ("g", "g1", "c"))))
    return found[0].unionByName(found[1]).distinct()


def _moved(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the components that their own have become."""
    moved = rows.join(roots.select(F.col("node").alias("c"), "root"), "c", "left")
    return moved.withColumn("c", F.coalesce("root", "c")).drop("root")


def _meetings(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (g, g1, c, g_, g1_, c_) of holders of one token in different components.

    Each pair has a holder outside the token's ``major`` component; where both are, the smaller
    one asks. The first token that a pair shares is never among the tokens before both places,
    and passes every bound if the pair can link, so dropping a later meeting loses nothing.
    """
    carried = ("g", "g1", "n", "pos", "c", "size", "bits", "whole", "before")
    other = entries.select("kind", "token", *(F.col(x).alias(f"{x}_") for x in carried))
    once = (F.col("c_") == F.col("major")) | (F.struct("c", "g", "g1") < F.struct("c_", "g_", "g1_"))
    return (
        entries.filter("c <> major").join(other, ["kind", "token"])
        .filter((F.col("c") != F.col("c_")) & once)
        .filter(_can_reach("n", "n_", "pos", "pos_", num, den) & _can_share(num, den))
        .filter(_can_agree("n", "n_", "whole", "whole_", num, den))
        .filter(~F.arrays_overlap("before", "before_"))
        .select("g", "g1", "c", "g_", "g1_", "c_")
    )


def _promising(pairs: DataFrame, grouped: DataFrame, a: list[str], b: list[str], num: int, den: int) -> DataFrame:
    """Group pairs whose prefixes share enough.

    What is shared outside both prefixes lies in the rest of the set whose prefix ends first.
    """
    sides = []
    for columns, n, tokens, rest in ((a, "_n", "_t", "_r"), (b, "_m", "_u", "_s")):
        sides.append(grouped.select(
            F.col("g").alias(columns[0]), F.col("g1").alias(columns[1]), F.col("n").alias(n), F.col("tokens").alias(tokens),
            (F.col("n") - F.col("size")).alias(rest),
        ))
    met = pairs.join(sides[0], a).join(sides[1], b)
    rest = F.greatest("_r", "_s")
    shared = F.size(F.array_intersect("_t", "_u")) + rest
    return met.filter((num + den) * shared >= num * (F.col("_n") + F.col("_m"))).drop("_n", "_t", "_m", "_u", "_r", "_s")


def _verify(pairs: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, a1, b, b1) of classes whose sets are similar enough, as edges (a, b)."""

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        out = []
        texts = (t for pair in zip(x, y, strict=True) for t in pair)
        sets = (s for group in groups(texts, 1_000_000) for s in shingle_sets(group, words))
        for d, e in zip(x1, y1, strict=True):
            s, t = next(sets), next(sets)
            both = len(np.intersect1d(s, t, assume_unique=True))
            same = digest(s)[0] == d and digest(t)[0] == e
            out.append(same and den * both >= num * (len(s) + len(t) - both))
        return pd.Series(out, dtype=bool)

    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("_x"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("_y"))
    return (
        pairs.join(left, "a").join(right, "b")
        .filter(similar("_x", "_y", "a1", "b1"))
        .select("a", "b")
    )


def _ordered(a: str, a1: str, b: str, b1: str) -> list[Column]:
    """The pair with its smaller class first."""
    x, y = F.struct(F.col(a).alias("i"), F.col(a1).alias("d")), F.struct(F.col(b).alias("i"), F.col(b1).alias("d"))
    low, high = F.least(x, y), F.greatest(x, y)
    return [low["i"].alias("a"), low["d"].alias("a1"), high["i"].alias("b"), high["d"].alias("b1")]


def jaccard_components(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = 5,
    num: int = 80,
    den: int = 100,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: components of all links of the join.

    Two documents link when ``den * intersection >= num * union`` of their shingle sets; the
    component is named by its smallest id. Null, empty and wordless texts have an empty set and
    link with nothing, not even each other. A text with fewer than ``words`` words has its whole
    sequence as one shingle. Rows that share an id are one document of the graph. A row without an
    id keeps its size, gets a null component and links nothing. Other columns are not read.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    slices = _slices(docs)
    least = -(-num // (den - num)) if den > num else None
    measured = cut(_measure(docs, words, least, slices))
    rows = cut(measured.filter(F.col("kind") == _DOCUMENT).select("doc_id", "n", "d1", "d2"))
    named = rows.filter("n > 0 and doc_id is not null")
    classes = cut(named.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("head")))

    heads = classes.select(F.col("head").alias("doc_id"), "n", "d1", "d2")
    prefixes = _prefixes(measured, words, num, den, slices).join(heads, ["doc_id", "n", "d1", "d2"], "left_semi")
    prefixes = cut(prefixes.dropDuplicates(["doc_id", "n", "d1"]).drop("d2"))
    discard(measured)  # it holds every text
    member = F.struct("doc_id", "d1")
    prefix = ["size", "places", "tokens", "bits"]
    # The map of a group is that of its set; a group of several sets has none.
    grouped = prefixes.groupBy("n", "p1", "p2").agg(
        F.min(member).alias("g"), F.min_by(F.struct(*prefix), member).alias("t"),
        F.when(F.count(F.lit(1)) == 1, F.first("whole")).alias("whole"),
    )
    grouped = cut(grouped.select(F.col("g.doc_id").alias("g"), F.col("g.d1").alias("g1"), "n", "p1", "p2", "t.*", "whole"))
    members = cut(
        prefixes.drop(*prefix).join(grouped.drop(*prefix, "whole"), ["n", "p1", "p2"]).select("doc_id", "d1", "g", "g1", "n", "whole")
    )

    postings = grouped.select("g", "g1", "n", F.explode(F.arrays_zip("places", "tokens")).alias("t"))
    postings = postings.select("g", "g1", "n", F.col("t.places").alias("pos"), F.col("t.tokens").alias("token"))
    holder = F.struct("n", "g", "g1", "pos")
    ends = (
        postings.groupBy("token")
        .agg(F.count(F.lit(1)).alias("_c"), F.min(holder).alias("low"), F.max(holder).alias("high"))
        .filter("_c > 1").drop("_c")
    )
    shared = cut(postings.join(ends, "token"))

    # First round: every holder with the smallest and the largest one that it meets most often;
    # members with their head.
    first = []
    for end in ("low", "high"):
        often = (
            shared.filter(F.struct("g", "g1") != F.struct(f"{end}.g", f"{end}.g1"))
            .filter(_can_reach("n", f"{end}.n", "pos", f"{end}.pos", num, den))
            .groupBy("g", "g1", F.struct(f"{end}.g", f"{end}.g1").alias("e")).agg(F.count(F.lit(1)).alias("_c"))
            .groupBy("g", "g1").agg(F.max_by("e", F.struct("_c", "e")).alias("e"))
        )
        first.append(often.select(*_ordered("g", "g1", "e.g", "e.g1")))
    outer = _promising(first[0].unionByName(first[1]).distinct(), grouped, ["a", "a1"], ["b", "b1"], num, den)
    inner = members.filter(F.struct("doc_id", "d1") != F.struct("g", "g1"))
    candidates = outer.unionByName(inner.select(*_ordered("doc_id", "d1", "g", "g1"))).distinct()
    edges = cut(_verify(candidates, docs, words, num, den))
    roots = cut(connected_components(edges).dropDuplicates(["node"]))

    # Second round: holders of one shingle, or of one prefix, in different components.
    placed = cut(
        members.join(roots, members["doc_id"] == roots["node"], "left")
        .select("doc_id", "d1", "g", "g1", "n", "whole", F.coalesce("root", "doc_id").alias("c"))
    )
    kinds = placed.select("g", "g1", "n", "c").distinct()
    by_token = shared.drop("low", "high").join(kinds.drop("n"), ["g", "g1"]).withColumn("kind", F.lit(0))
    split = kinds.groupBy("g", "g1").agg(F.min("c").alias("_a"), F.max("c").alias("_b")).filter("_a <> _b")
    by_group = kinds.join(split, ["g", "g1"], "left_semi").select(
        "g", "g1", "n", F.lit(0).alias("pos"), F.xxhash64("g", "g1").alias("token"), "c", F.lit(1).alias("kind")
    )
    entries = by_token.unionByName(by_group)
    described = grouped.select("g", "g1", "size", "bits", "whole", "places", "tokens")
    at = F.when(F.col("kind") == 0, F.array_position("places", F.col("pos").cast("int")) - 1).otherwise(0).cast("int")
    before = F.slice("tokens", F.greatest(at - BEFORE, F.lit(0)) + 1, F.least(at, F.lit(BEFORE)))
    entries = _mixed(entries).join(described, ["g", "g1"])
    entries = cut(entries.withColumn("before", before).drop("places", "tokens"))
    for _ in range(MOST_ROUNDS):
        hooks = _hooks(entries, num, den)
        first = placed.groupBy("g", "g1", "c").agg(F.min(F.struct("doc_id", "d1")).alias("x"))
        other = first.select(*(F.col(x).alias(f"{x}_") for x in ("g", "g1", "c")), F.col("x").alias("y"))
        hooks = hooks.join(first, ["g", "g1", "c"]).join(other, ["g_", "g1_", "c_"])
        hooks = cut(hooks.select(*_ordered("x.doc_id", "x.d1", "y.doc_id", "y.d1")).distinct())
        joined = cut(_verify(hooks, docs, words, num, den))
        links = joined.count()
        if not links:
            break
        edges = edges.unionByName(joined)
        roots = cut(connected_components(edges).dropDuplicates(["node"]))
        placed = cut(_moved(placed, roots))
        entries = cut(_mixed(_moved(entries.drop("major"), roots)))
        if links < WORTH_A_ROUND * hooks.count():
            break
    met = _promising(_meetings(entries, num, den).distinct(), grouped, ["g", "g1"], ["g_", "g1_"], num, den)
    left = placed.select("g", "g1", "c", F.col("n").alias("_n"), F.col("whole").alias("_w"), F.col("doc_id").alias("x"), F.col("d1").alias("x1"))
    right = placed.select(
        F.col("g").alias("g_"), F.col("g1").alias("g1_"), F.col("c").alias("c_"), F.col("n").alias("_m"),
        F.col("whole").alias("_v"), F.col("doc_id").alias("y"), F.col("d1").alias("y1"),
    )
    late = met.join(left, ["g", "g1", "c"]).join(right, ["g_", "g1_", "c_"]).filter(_can_agree("_n", "_m", "_w", "_v", num, den))
    late = late.select(*_ordered("x", "x1", "y", "y1")).distinct()
    late = cut(_verify(late, docs, words, num, den))
    # Documents of one id are one node even if their sets differ.
    same = named.join(classes, ["n", "d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    extra = same.join(named.groupBy("doc_id").agg(F.count_distinct("d1", "n").alias("_k")).filter("_k > 1"), same["a"] == F.col("doc_id"), "left_semi")
    final = connected_components(edges.unionByName(late).unionByName(extra)).dropDuplicates(["node"])

    named_classes = classes.join(final, classes["head"] == final["node"], "left").select(
        F.col("n").alias("_n"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"),
        F.coalesce("root", "head").alias("_component"),
    )
    known = F.col("doc_id").isNotNull()
    return rows.join(
        named_classes,
        (F.col("n") == F.col("_n")) & (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")), "left",
    ).select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(known, F.coalesce("_component", "doc_id")).alias("component_id"),
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component: the one whose id names it.

    Of rows that share this id one stays, the least by all its columns from the first on, so reruns
    agree; columns must be of types that have an order. Rows without an id all stay.
    """
    found = jaccard_components(docs, doc_id, text, words, num, den)
    (name,) = unused(docs.columns, "_gone")
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(gone, F.col(doc_id).cast("long") == F.col(name), "left_anti")
    nameless = kept.filter(F.col(doc_id).isNull())
    named = kept.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias(name)).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return named.select("row.*").unionByName(nameless)
