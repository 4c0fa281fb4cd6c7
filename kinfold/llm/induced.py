"""Suffix and common-prefix arrays of one shard by external induced sorting.

Suffixes are sorted as far as ``depth`` characters. Type L suffixes are larger than their right
neighbour, type S smaller; the leftmost of a run of S are the seeds. From the order of the seeds,
one ascending scan induces all L and one descending scan all S: whoever is scanned pushes its left
neighbour into the queue of that neighbour's first character, where it arrives in the right order.
The order of the seeds comes by recursion: the seeds sorted by first character only induce the
order of the pieces between seeds, equal pieces get equal names, and the string of names, half as
long at most, is ranked.

Tuples (position, common prefix with the one before in the queue) wait in disk-backed queues. A
common prefix is one more than the smallest common prefix scanned since the last push into the
same queue.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

import numpy as np

SENTINEL, SEPARATOR, FIRST_BYTE = 0, 1, 2
ALPHABET = 258
# Bytes of tuples that queues hold in memory before they go to disk, and rows in one step.
QUEUE_BYTES = 64 << 20
STEP = 1 << 18


def scratch_file():
    """A nameless file where Spark itself spills; it is gone when closed, even after a crash.

    Only the task that opened it ever reads it, like a sort's spill.
    """
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
    return tempfile.TemporaryFile(dir=folder if folder and os.path.isdir(folder) else None)


def scratch(n: int, dtype: type, limit: int = QUEUE_BYTES) -> np.ndarray:
    """An array, on disk if it is larger than ``limit`` bytes."""
    if n * np.dtype(dtype).itemsize <= limit or not n:
        return np.empty(n, dtype)
    return np.memmap(scratch_file(), dtype, "w+", shape=(n,))


class Queues:
    """First-in first-out queues of (position, prefix) by character, on disk beyond a limit."""

    def __init__(self, limit: int = QUEUE_BYTES):
        self.limit, self.held, self.file = limit, 0, None
        self.parts: list[list[tuple]] = [[] for _ in range(ALPHABET)]
        self.spilled = 0

    def push(self, char: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.parts[char].append((positions, prefixes))
        self.held += positions.nbytes + prefixes.nbytes
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = scratch_file()
        self.file.seek(0, os.SEEK_END)
        for parts in self.parts:
            for k, part in enumerate(parts):
                if len(part) == 2:
                    at = self.file.tell()
                    self.file.write(part[0].tobytes())
                    self.file.write(part[1].tobytes())
                    parts[k] = (at, len(part[0]), part[0].dtype)
        self.spilled += self.held
        self.held = 0

    def take(self, char: int, last: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """The oldest tuples of a queue, about ``STEP`` at most; None once it is empty.

        With ``last`` the newest ones, still in the order in which they were pushed.
        """
        parts = self.parts[char]
        if not parts:
            return None
        rows, count = 0, 0
        while count < len(parts) and rows < STEP:
            part = parts[-1 - count if last else count]
            rows += len(part[0]) if len(part) == 2 else part[1]
            count += 1
        if last:
            taken, self.parts[char] = parts[-count:], parts[:-count]
        else:
            taken, self.parts[char] = parts[:count], parts[count:]
        read = [self._read(part) for part in taken]
        if len(read) == 1:
            return read[0]
        return np.concatenate([p for p, _ in read]), np.concatenate([c for _, c in read])

    def _read(self, part: tuple) -> tuple[np.ndarray, np.ndarray]:
        if len(part) == 2:
            self.held -= part[0].nbytes + part[1].nbytes
            return part
        at, n, dtype = part
        self.file.seek(at)
        positions = np.frombuffer(self.file.read(n * dtype.itemsize), dtype)
        return positions, np.frombuffer(self.file.read(n), np.uint8)


_LOG = np.zeros(2 * STEP + 2, np.int64)
_LOG[1:] = np.log2(np.arange(1, len(_LOG))).astype(np.int64)


class _Minima:
    """Smallest value of any range, from the minima of all ranges of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray):
        tables, width = [values], 1
        while 2 * width <= len(values):
            tables.append(np.minimum(tables[-1][:-width], tables[-1][width:]))
            width *= 2
        self.flat = np.concatenate(tables)
        self.at = np.cumsum([0, *map(len, tables)])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Minimum of every range [begin, end), each at least one long."""
        level = _LOG[end - begin]
        row = self.at[level]
        return np.minimum(self.flat[row + begin], self.flat[row + end - (1 << level)]).astype(np.int16)


class _Carry:
    """Smallest common prefix scanned since the last push into each queue."""

    def __init__(self, depth: int):
        self.depth = depth
        self.least = np.full(ALPHABET, -1, np.int16)  # -1: nothing was pushed yet

    def pushed(self, prefixes: np.ndarray, index: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order by queue of the pushes at ``index`` of a scanned run, and their prefixes."""
        order = np.argsort(chars, kind="stable")
        k, c = index[order], chars[order].astype(np.intp)
        tables = _Minima(prefixes)
        head = np.ones(len(c), bool)
        head[1:] = c[1:] != c[:-1]
        begin = np.where(head, 0, np.concatenate([[0], k[:-1] + 1]))
        found = tables.of(begin, k + 1)
        before = self.least[c]
        found = np.where(head, np.where(before < 0, -1, np.minimum(found, before)), found)
        known = self.least >= 0
        self.least[known] = np.minimum(self.least[known], prefixes.min())
        tail = np.ones(len(c), bool)
        tail[:-1] = c[1:] != c[:-1]
        begin = k[tail] + 1
        rest = np.full(len(begin), self.depth, np.int16)
        inside = begin < len(prefixes)
        rest[inside] = tables.of(begin[inside], np.full(inside.sum(), len(prefixes)))
        self.least[c[tail]] = rest
        return order, np.minimum(found + 1, self.depth).astype(np.uint8)

    def idle(self, prefixes: np.ndarray) -> None:
        known = self.least >= 0
        self.least[known] = np.minimum(self.least[known], prefixes.min())


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int, enough: np.ndarray | None = None) -> np.ndarray:
    """Common prefix of pairs of suffixes up to ``depth``, four characters at a time.

    A pair that agrees in ``enough`` characters is not looked at further and counts as agreeing.
    Nothing runs over the end: the sentinel ends every suffix and occurs once.
    """
    words = np.ndarray(len(text), "<u8", np.concatenate([text, np.zeros(3, text.dtype)]), strides=(2,))
    out = np.full(len(a), depth, np.uint8)
    live = np.arange(len(a))
    for j in range(0, depth, 4):
        x, y = a[live] + j, b[live] + j
        differ = words[x] ^ words[y]
        # Zero bits below the lowest that differs, by 16 to the character.
        same = np.full(len(live), 4)
        odd = differ != 0
        low = differ[odd] & (~differ[odd] + np.uint64(1))
        same[odd] = (np.log2(low.astype(np.float64)) // 16).astype(np.int64)
        out[live[odd]] = np.minimum(j + same[odd], depth)
        live = live[~odd]
        if enough is not None:
            live = live[enough[live] > j + 4]
        if not len(live):
            break
    return out


class Shard:
    """One text of separated segments; ``text`` ends in the sentinel."""

    def __init__(self, text: np.ndarray, depth: int, limit: int = QUEUE_BYTES):
        self.text, self.depth, self.limit = text, depth, limit
        n = len(text)
        self.index = np.int32 if n < 2**31 else np.int64
        up = np.ones(n, np.int8)
        up[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1])
        # Where neighbours are equal the next difference decides.
        at = np.where(up != 0, np.arange(n, dtype=self.index), self.index(n - 1))
        at = np.minimum.accumulate(at[::-1])[::-1]
        self.is_s = up[at] > 0
        seeds = self.is_s.copy()
        seeds[1:] &= ~self.is_s[:-1]
        seeds[0] = False
        self.seeds = np.flatnonzero(seeds).astype(self.index)
        self.spilled = 0

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, prefixes): suffixes from the largest down, each with the one before it.

        The sentinel is left out. Common prefixes are exact up to ``depth``.
        """
        seeds = self._ranked_seeds()
        prefixes = np.zeros(len(seeds), np.uint8)
        prefixes[1:] = _common(self.text, seeds[:-1], seeds[1:], self.depth)
        return self._induce(seeds, prefixes)

    def _ranked_seeds(self) -> np.ndarray:
        """The seeds in the order of their suffixes, by names of the pieces between seeds."""
        text, seeds = self.text, self.seeds
        by_char = seeds[np.argsort(text[seeds], kind="stable")]
        positions, _ = self._induce(by_char, None)
        is_seed = np.zeros(len(text), bool)
        is_seed[seeds] = True
        places = np.flatnonzero(is_seed[positions])
        if not len(places):
            return seeds
        found = np.asarray(positions[places])
        number = np.zeros(len(text), self.index)
        number[seeds] = np.arange(len(seeds))
        rows = number[found]
        # A piece reaches up to and with the first character of the next one.
        lengths = np.diff(seeds, append=len(text))[rows]
        longer = np.minimum(self.depth, np.maximum(lengths[1:], lengths[:-1]) + 1)
        same = np.zeros(len(found), bool)
        same[1:] = _common(text, found[1:], found[:-1], self.depth, longer) >= longer
        names = np.zeros(len(seeds), np.int64)  # the sentinel keeps 0
        groups = np.cumsum(~same)
        names[rows] = groups[-1] - groups + 1
        # The string of names: ranks of 1, 2, 4, ... names. A piece has two characters or more.
        span = 1
        while 2 * span <= self.depth + 1 and names.max(initial=0) + 1 < len(names):
            following = np.zeros(len(names), np.int64)
            following[:-span] = names[span:]
            _, names = np.unique(names * (len(names) + 1) + following, return_inverse=True)
            span *= 2
        return seeds[np.argsort(names, kind="stable")]

    def _scan(self, queues: Queues, carry: _Carry | None, positions: np.ndarray, prefixes: np.ndarray, want_s: bool) -> None:
        """Push the left neighbours of the wanted type."""
        index = np.flatnonzero((positions > 0) & (self.is_s[positions - 1] == want_s))
        if not len(index):
            if carry:
                carry.idle(prefixes)
            return
        left = positions[index] - self.index(1)
        chars = self.text[left]
        if carry:
            order, found = carry.pushed(prefixes, index, chars)
        else:
            order, found = np.argsort(chars, kind="stable"), np.zeros(len(index), np.uint8)
        left, chars = left[order], chars[order]
        cuts = np.flatnonzero(np.diff(chars)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(chars)], strict=True):
            queues.push(int(chars[a]), left[a:b], found[a:b])

    def _induce(self, seeds: np.ndarray, seed_prefixes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes from the order of the seeds; without their prefixes, the order alone."""
        text, depth = self.text, self.depth
        exact = seed_prefixes is not None
        seed_prefixes = seed_prefixes if exact else np.zeros(len(seeds), np.uint8)
        bounds = np.searchsorted(text[seeds], np.arange(ALPHABET + 1))
        # Ascending: what is already known of a character's L suffixes, then its seeds.
        waiting, done, carry = Queues(self.limit), Queues(self.limit), _Carry(depth) if exact else None
        for char in range(ALPHABET):
            final = None
            while (part := waiting.take(char)) is not None:
                for at in range(0, len(part[0]), STEP):
                    positions, prefixes = part[0][at : at + STEP], part[1][at : at + STEP]
                    done.push(char, positions, prefixes)
                    self._scan(waiting, carry, positions, prefixes, False)
                    final = positions[-1]
            a, b = bounds[char], bounds[char + 1]
            for at in range(a, b, STEP):
                positions = seeds[at : min(at + STEP, b)]
                prefixes = seed_prefixes[at : min(at + STEP, b)].copy()
                if at == a:
                    prefixes[0] = 0 if final is None else _common(text, np.array([final]), positions[:1], depth)[0]
                self._scan(waiting, carry, positions, prefixes, False)
        # Descending: a character's S suffixes, then its L suffixes from behind.
        found = scratch(len(text) - 1, self.index, self.limit)
        common = scratch(len(text) - 1, np.uint8, self.limit)
        queues, carry, size = Queues(self.limit), _Carry(depth) if exact else None, 0
        for char in range(ALPHABET - 1, -1, -1):
            final = None
            while (part := queues.take(char)) is not None:
                for at in range(0, len(part[0]), STEP):
                    positions, prefixes = part[0][at : at + STEP], part[1][at : at + STEP]
                    found[size : size + len(positions)] = positions
                    common[size : size + len(positions)] = prefixes
                    size += len(positions)
                    self._scan(queues, carry, positions, prefixes, True)
                    final = positions[-1]
            link = None
            while (part := done.take(char, last=True)) is not None:
                positions = part[0][::-1]
                prefixes = np.empty(len(positions), np.uint8)
                prefixes[1:] = part[1][1:][::-1]
                if link is None:
                    link = 0 if final is None else _common(text, np.array([final]), positions[:1], depth)[0]
                prefixes[0] = link
                link = part[1][0]
                found[size : size + len(positions)] = positions
                common[size : size + len(positions)] = prefixes
                size += len(positions)
                self._scan(queues, carry, positions, prefixes, True)
        self.spilled += waiting.spilled + done.spilled + queues.spilled
        return found[:size], common[:size]


def join_segments(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The text of a shard, and where each segment begins."""
    data = np.frombuffer(b"\0".join(segments), np.uint8)
    text = np.empty(len(data) + 1, np.uint16)
    text[:-1] = data.astype(np.uint16) + FIRST_BYTE
    text[-1] = SENTINEL
    lengths = np.array([len(s) for s in segments], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    text[starts[1:] - 1] = SEPARATOR
    return text, starts


def window_minima(
    segments: list[bytes], owner: np.ndarray, depth: int, limit: int = QUEUE_BYTES,
    watch: Callable[[Shard], None] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``depth`` bytes, the smallest owner among all equal windows.

    Returns values by place in the joined text (places that start no window keep the largest
    number), and where each segment begins.
    """
    text, starts = join_segments(segments)
    lengths = np.array([len(s) for s in segments], np.int64)
    segment = np.repeat(np.arange(len(segments), dtype=np.int32), lengths + 1)[: len(text) - 1]
    is_window = np.arange(len(text) - 1) + depth <= (starts + lengths)[segment]
    shard = Shard(text, depth, limit)
    positions, common = shard.order()
    if watch:
        watch(shard)
    begins = np.flatnonzero(common < depth)
    if not len(begins) or begins[0]:
        begins = np.concatenate([[0], begins])
    values = np.where(is_window, owner[segment], np.iinfo(np.int64).max)
    out = np.full(len(text) - 1, np.iinfo(np.int64).max, np.int64)
    if len(positions):
        low = np.minimum.reduceat(values[positions], begins)
        out[positions] = np.repeat(low, np.diff(begins, append=len(positions)))
    out[~is_window] = np.iinfo(np.int64).max
    return out, starts
