"""External induced sorting of the suffixes of a text, with common-prefix values.

The order of all suffixes comes from that of the few suffixes that begin a rising run after a falling
one (LMS). These are sorted by the text up to the next of their kind (``_induce`` over them in any
order), named, and the string of names is sorted in turn: by this same induction as long as it is
longer than ``IN_MEMORY``, by prefix doubling below that. Then one sweep up the alphabet induces the
falling (L) suffixes from the LMS ones, one sweep down the rising (S) ones from the L ones.

A sweep is driven by a priority queue of suffix tuples (position, common prefix with the tuple before),
keyed by their first symbol. Keys leave in one direction only, so the queue is a bucket for each key,
first in, first out; whatever exceeds ``memory`` bytes is appended to spill files in the executor's
spill folder (SPARK_LOCAL_DIRS, as Spark's own spills) and read back when its key's turn comes. The common-prefix value of two neighbours
in a bucket is one more than the smallest value between the suffixes they were induced from; a running
minimum for each symbol carries it across batches. Values are capped at ``cap``, and so is the depth of
the order: suffixes that agree on ``cap`` symbols may come in any order, next to each other.

A sweep handles all tuples of a key at once, so its Python cost is by batch, not by suffix.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Names that are sorted by doubling in memory.
IN_MEMORY = 1 << 22
MEMORY = 8 << 20


def spill_folder() -> str | None:
    """Spark's spill folder on this executor, or None for the default (outside Spark, in tests)."""
    folders = [f for f in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if f and os.path.isdir(f)]
    return folders[os.getpid() % len(folders)] if folders else None


def array(n: int, dtype: type, memory: int = MEMORY) -> np.ndarray:
    """Zeros; beyond ``memory`` bytes a file of the spill folder, of which only the pages in use stay in memory."""
    if n * np.dtype(dtype).itemsize <= memory:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile(prefix="veldspar-", dir=spill_folder()) as file:  # unlinked; the mapping keeps it
        return np.memmap(file, dtype, "w+", shape=(n,))


class Queue:
    """Priority queue of (position, value) tuples with monotone keys; disk-backed beyond ``memory`` bytes."""

    def __init__(self, memory: int = MEMORY) -> None:
        self.memory, self.held = memory, 0
        self.buckets: dict[int, list] = {}
        self.file = None
        self.spilled = 0

    def push(self, key: int, positions: np.ndarray, values: np.ndarray) -> None:
        self.buckets.setdefault(key, []).append((positions, values))
        self.held += positions.nbytes + values.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="veldspar-", dir=spill_folder())  # unlinked: gone with the task
        for parts in self.buckets.values():
            for i, part in enumerate(parts):
                if isinstance(part[0], np.ndarray):
                    at = self.file.seek(0, os.SEEK_END)
                    self.file.write(part[0].tobytes())
                    self.file.write(part[1].tobytes())
                    parts[i] = (at, len(part[0]), part[0].dtype)
                    self.spilled += len(part[0])
        self.held = 0

    def pop(self, key: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All tuples of a key, in the order they came."""
        parts = self.buckets.pop(key, None)
        if not parts:
            return None
        loaded = []
        for part in parts:
            if isinstance(part[0], np.ndarray):
                self.held -= part[0].nbytes + part[1].nbytes
                loaded.append(part)
            else:
                at, n, dtype = part
                self.file.seek(at)
                positions = np.frombuffer(self.file.read(n * dtype.itemsize), dtype)
                loaded.append((positions, np.frombuffer(self.file.read(n), np.uint8)))
        if len(loaded) == 1:
            return loaded[0]
        return np.concatenate([p for p, _ in loaded]), np.concatenate([v for _, v in loaded])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.buckets.clear()


def rising(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it (S); the last symbol must be the smallest, and is S."""
    n = len(text)
    up = np.empty(n, bool)
    up[-1] = True
    up[:-1] = text[:-1] < text[1:]
    same = np.zeros(n, bool)
    same[:-1] = text[:-1] == text[1:]
    if same.any():  # a run of equal symbols takes the type of its last
        index = np.where(same, n, np.arange(n))
        ends = np.minimum.accumulate(index[::-1])[::-1]
        up = up[ends]
    return up


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of the suffixes at a and at b, up to ``cap``; bytes are compared eight at a time."""
    out = np.zeros(len(a), np.uint8)
    last = len(text) - 1
    live, depth = np.arange(len(a)), 0
    if text.dtype == np.uint8:
        eight = np.arange(8)
        while len(live) and depth < cap:
            x, y = a[live] + depth, b[live] + depth
            inside = np.maximum(x, y) + 7 <= last
            differ = np.zeros(len(live), np.uint64)
            differ[inside] = (text[x[inside, None] + eight].view(">u8") ^ text[y[inside, None] + eight].view(">u8")).ravel().astype(np.uint64)
            done = inside & (differ != 0)
            out[live[done]] = depth + _equal_bytes(differ[done])
            near = live[~inside]
            out[near] = depth + _common(text, a[near] + depth, b[near] + depth, cap - depth)
            live = live[inside & (differ == 0)]
            depth += 8
        out[live] = cap
        return np.minimum(out, cap)
    return _common(text, a, b, cap)


def _equal_bytes(differ: np.ndarray) -> np.ndarray:
    """Zero bytes at the top of non-zero 64-bit numbers."""
    out = np.zeros(len(differ), np.uint8)
    for shift in range(8, 64, 8):
        out += differ >> np.uint64(64 - shift) == 0
    return out


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    out = np.zeros(len(a), np.uint8)
    live = np.arange(len(a))
    last = len(text) - 1
    for depth in range(cap):
        x, y = a[live] + depth, b[live] + depth
        inside = (x <= last) & (y <= last)
        live = live[inside][text[x[inside]] == text[y[inside]]]
        if not len(live):
            break
        out[live] = depth + 1
    return out


class _Minima:
    """For each symbol the smallest common-prefix value since a suffix before it was last induced."""

    def __init__(self, symbols: int, cap: int) -> None:
        self.run = np.full(symbols, cap, np.uint8)
        self.seen = np.zeros(symbols, bool)
        self.cap = cap

    def split(self, before: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For every symbol that precedes a wanted suffix: the symbol, where in the batch, the induced values."""
        if not len(values):
            return
        at = np.flatnonzero(wanted)
        low = values.min()
        if not len(at):
            np.minimum(self.run, low, out=self.run)
            return
        order = at[np.argsort(before[at], kind="stable")]
        symbols = before[order]
        begins = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        ends = np.append(begins[1:], len(order))
        out = []
        for i, j in zip(begins.tolist(), ends.tolist()):
            c, where = int(symbols[i]), order[i:j]
            first = values[: where[0] + 1].min()
            new = np.empty(len(where), np.uint8)
            new[0] = min(first, self.run[c]) if self.seen[c] else 0
            if len(where) > 1:  # the smallest value after one place up to and with the next
                new[1:] = np.minimum.reduceat(values[: where[-1] + 1], where[:-1] + 1)
            rest = values[where[-1] + 1 :]
            out.append((c, where, new, rest.min() if len(rest) else self.cap))
        kept = np.minimum(self.run, low)
        for c, _, _, rest in out:
            kept[c] = rest
        self.run = kept
        for c, where, new, _ in out:
            induced = np.minimum(new + 1, self.cap).astype(np.uint8)
            if not self.seen[c]:
                induced[0] = 0
                self.seen[c] = True
            yield c, where, induced


def _induce(text: np.ndarray, up: np.ndarray, seeds: np.ndarray, values: np.ndarray | None, cap: int, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in falling order, in batches with the common prefix with the suffix before (in that order).

    ``seeds``: the LMS positions in rising order, ``values`` their common prefixes with the seed before;
    without them only the order is induced and all values are 0.
    """
    symbols = int(text.max()) + 1
    first = text[seeds]
    bounds = np.searchsorted(first, np.arange(symbols + 1))
    queue, falling, heads = Queue(memory), Queue(memory), {}
    minima = _Minima(symbols, cap)
    track = values is not None
    last = -1  # the suffix handled before, for the few common prefixes that no induction gives

    def sweep(batch: np.ndarray, lcp: np.ndarray, minima: _Minima, queue: Queue, kind_up: bool) -> None:
        before = text[batch - 1]  # position 0 wraps; it is never wanted
        wanted = (batch > 0) & (up[batch - 1] == kind_up)
        if track:
            for c, where, induced in minima.split(before, lcp, wanted):
                queue.push(c, batch[where] - 1, induced)
            return
        at = np.flatnonzero(wanted)
        order = at[np.argsort(before[at], kind="stable")]
        kinds = before[order]
        edges = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1])) if len(order) else []
        for i, j in zip(edges, [*edges[1:], len(order)]):
            queue.push(int(kinds[i]), batch[order[i:j]] - 1, np.zeros(j - i, np.uint8))

    for c in range(symbols):
        while (got := queue.pop(c)) is not None:
            batch, lcp = got
            heads.setdefault(c, int(batch[0]))
            falling.push(c, batch, lcp)
            sweep(batch, lcp, minima, queue, False)
            last = int(batch[-1])
        lo, hi = bounds[c], bounds[c + 1]
        if lo < hi:
            batch, lcp = seeds[lo:hi], values[lo:hi].copy() if track else None
            if track:
                lcp[0] = common(text, np.array([last]), batch[:1], cap)[0] if last >= 0 else 0
            sweep(batch, lcp, minima, queue, False)
            last = int(batch[-1])
    queue.close()

    queue, minima = Queue(memory), _Minima(symbols, cap)
    last = -1

    def glue(batch: np.ndarray) -> int:
        return int(common(text, np.array([last]), batch[:1], cap)[0]) if track and last >= 0 else 0

    for c in range(symbols - 1, -1, -1):
        fresh = True
        while (got := queue.pop(c)) is not None:
            batch, lcp = got
            if fresh:
                lcp = lcp.copy()
                lcp[0], fresh = glue(batch), False
            yield batch, lcp
            sweep(batch, lcp, minima, queue, True)
            last = int(batch[-1])
        if c == int(text[-1]):  # the end of the text is the smallest suffix of all
            batch = np.array([len(text) - 1], seeds.dtype)
            yield batch, np.array([glue(batch)], np.uint8)
            last = len(text) - 1
        if (got := falling.pop(c)) is not None:
            batch, lcp = got
            down = np.empty(len(lcp), np.uint8)
            down[1:] = lcp[:0:-1]
            batch = batch[::-1]
            down[0] = glue(batch)
            yield batch, down
            sweep(batch, down, minima, queue, True)
            last = int(batch[-1])
    queue.close()
    falling.close()


def _name(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the stretches from each LMS position to the next, in text order; equal stretches, equal names."""
    lengths = np.append(lms[1:] - lms[:-1], 0) + 1
    rank = np.empty(len(text), lms.dtype)
    rank[lms] = np.arange(len(lms))
    seq = rank[order]
    a, b = order[:-1], order[1:]
    size = lengths[seq]
    differ = size[:-1] != size[1:]
    live, depth = np.flatnonzero(~differ), 0
    while len(live):
        live = live[size[live] > depth]
        same = text[a[live] + depth] == text[b[live] + depth]
        differ[live[~same]] = True
        live = live[same]
        depth += 1
    names = np.empty(len(lms), np.int64)
    names[seq] = np.append(0, np.cumsum(differ))
    return names, int(names.max()) + 1


def _double(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``names``, equal up to ``depth`` names counting as equal."""
    rank, span = names, 1
    while span < depth:
        after = np.zeros(len(rank), np.int64)
        after[: len(rank) - span] = rank[span:] + 1
        _, rank = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)
        span *= 2
        if int(rank.max()) + 1 == len(rank):
            break
    return np.argsort(rank, kind="stable")


def suffixes(text: np.ndarray, cap: int, memory: int = MEMORY, in_memory: int = IN_MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of (positions, common prefix with the suffix before) over all suffixes in falling order.

    ``text``: an integer array whose last symbol is smaller than every other one or a separator 0 that
    no stretch of interest contains. ``cap`` is below 255. An empty text has no suffixes.
    """
    if not len(text):
        return
    kind = np.int32 if len(text) < 1 << 31 else np.int64
    if len(text) == 1:
        yield np.zeros(1, kind), np.zeros(1, np.uint8)
        return
    up = rising(text)
    starts = up.copy()
    starts[1:] &= ~up[:-1]
    starts[0] = False
    lms = np.flatnonzero(starts).astype(kind)
    loose = lms[np.argsort(text[lms], kind="stable")]
    order = np.concatenate([b[starts[b]] for b, _ in _induce(text, up, loose, None, cap, memory)])[::-1]
    names, count = _name(text, lms, order)
    if count < len(lms):
        if len(lms) > in_memory:
            rising_order = np.concatenate([b for b, _ in suffixes(np.append(names + 1, 0), cap, memory, in_memory)])[::-1]
            rising_order = rising_order[rising_order < len(names)]
        else:
            rising_order = _double(names, cap)  # cap names are cap symbols at least
        order = lms[rising_order]
    values = np.zeros(len(order), np.uint8)
    values[1:] = common(text, order[:-1], order[1:], cap)
    yield from _induce(text, up, order, values, cap, memory)
