"""Exact substring removal: bytes covered by a string of ``LENGTH`` bytes that starts in an earlier document too.

Suffixes are sorted by external induction (suffixes.py), shard by shard; neighbours whose common prefix
is ``LENGTH`` or more form a run, and the smallest doc_id of a run decides for all of its members.

Sorting every suffix of the corpus in one array would move its queues' tuples, several times the text,
through the disks. So the text is sharded first, without losing a match:

1. ``blocks``: documents are packed into blocks of about ``BLOCK`` bytes, written once (compressed) as a
   table bucketed by block. A task only uses block ids of its own bucket, so this moves nothing, and
   later joins by block find the texts in place.
2. Every ``LENGTH``-byte string has one anchor: the ``K``-byte string in it with the smallest hash, the
   leftmost of equals, widened to ``2 * K`` bytes on the side where the string has room (in a large
   corpus most strings of ``K`` bytes occur elsewhere by chance, of ``2 * K`` few do). Equal strings have
   equal anchors. Neighbouring starts share an anchor, so a block is a list of records (anchor, first
   start, last start), one for some 12 bytes.
3. Each block sends its distinct anchors' hashes to shards, six bytes each; a bitmap comes back telling
   which of them other documents have. What has no partner is done.
4. The stretches of the other records go to the shard of their anchor, equal stretches of a block once.
   There equal stretches are merged; anchors that still have several different stretches are
   concatenated and their suffixes sorted. A bit for each start comes back: does a smaller doc_id hold
   the string?
5. Each block cuts its documents.

Scale. No step collects rows of one key: a passage that a third of all documents hold is one stretch
a block in step 4. Tasks hold one block, or one shard (``SHARD`` bytes of corpus, so the number of shards
grows with the corpus); the suffix queues spill to disk. Shuffled: six bytes a record and the shared
stretches, compressed. Nothing reaches the driver but the corpus size.

Defined results: null text is an empty text; a null doc_id is larger than any other, so its document
never causes a removal but may lose bytes; rows with equal doc_id do not remove from each other;
extra columns are ignored; an empty table gives an empty result. Texts end at their last byte: matches
never cross documents.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.functions.shared import scratch, scratch_table
from veldspar.llm import suffixes as sx

LENGTH = 50
K = 16
#: An anchor with fewer bytes of its string before it is widened to the right, another one to the left.
HALF = 18
BLOCK = 4 << 20
#: Bytes of corpus for each shard and for each bucket of blocks.
SHARD, BUCKET = 10 << 20, 48 << 20
#: Bits for the places within a piece of text that is hashed at once (a piece stays in the processor's cache).
_PLACE = 17
#: Bytes of stretches whose suffixes are sorted at once, unless one anchor alone has more.
SORTED = 8 << 20
#: Stretches that are laid out at a time.
PART = 1 << 16
#: Rows of a shard that become Python objects at a time.
ROWS = 32
_LAST = (1 << 63) - 1
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


# ---- anchors -------------------------------------------------------------------------------------


def _hashes(text: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each place on."""
    h, span, turn = text.astype(np.uint64) + np.uint64(1), 1, 0
    while span < k:
        step = min(span, k - span)
        h = h[: len(h) - step] * _MIX[turn % len(_MIX)] + h[step:]
        h ^= h >> np.uint64(29)
        span, turn = span + step, turn + 1
    h *= _MIX[1]
    return h ^ h >> np.uint64(32)


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span < width:
        step = min(span, width - span)
        keys = np.minimum(keys[: len(keys) - step], keys[step:])
        span += step
    return keys


def runs(text: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(number of starts, place of the wide anchor after the first) of each run of starts with one anchor, as bytes.

    ``text``: bytes of the documents one after another, ``ends``: where each ends. Runs follow each other
    without gaps over the starts of all documents, so these two say where every run begins.
    """
    counts, offsets = [], []
    n, piece = len(text), (1 << _PLACE - 1)
    low = np.uint64((1 << _PLACE) - 1)
    end_at = np.repeat(ends, np.diff(ends, prepend=0))
    places = np.arange(piece + length, dtype=np.uint64)
    for a in range(0, max(0, n - length + 1), piece):
        part = text[a : min(n, a + piece + length - 1)]
        keys = _hashes(part, k)
        keys &= ~low
        keys |= places[: len(keys)]
        anchor = _smallest(keys, length - k + 1)
        end = end_at[a : a + len(anchor)]
        whole = np.arange(a + length, a + length + len(anchor)) <= end
        before = (anchor & low).astype(np.int64) - np.arange(len(anchor))
        left = before >= HALF
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (left[1:] != left[:-1]) | (end[1:] != end[:-1]) | (whole[1:] != whole[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(anchor)))
        first, count = first[whole[first]], count[whole[first]]
        counts.append(count.astype(np.uint8))
        offsets.append((before[first] - k * left[first]).astype(np.uint8))
    return tuple(np.concatenate(c) if c else np.zeros(0, np.uint8) for c in (counts, offsets))


def records(text: np.ndarray, ends: np.ndarray, counts: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, document's number, first start, number of starts) of each run."""
    sizes = np.diff(ends, prepend=0)
    starts = np.maximum(sizes - length + 1, 0)
    before = np.cumsum(starts) - starts
    count = counts.astype(np.int64)
    at = np.cumsum(count) - count
    doc = np.searchsorted(before + starts, at, "right")
    first = at - before[doc] + (ends - sizes)[doc]
    return _anchor_hashes(text, first + offsets), doc, first, count


def _anchor_hashes(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A hash of the wide anchor at each place, taken eight bytes at a time."""
    out = np.zeros(len(places), np.uint64)
    wide = np.lib.stride_tricks.sliding_window_view(text, 2 * K) if len(places) else None
    for a in range(0, len(places), 50_000):
        h = out[a : a + 50_000]
        for n, part in enumerate(wide[places[a : a + 50_000]].view("<u8").T):
            h += part
            h *= _MIX[n]
            h ^= h >> np.uint64(29)
        h *= _MIX[4]
        h ^= h >> np.uint64(32)
    return out >> np.uint64(_PLACE)


def _hash_rows(window: np.ndarray, k: int) -> np.ndarray:
    """``_hashes`` of every row."""
    h, span, turn = window.astype(np.uint64) + np.uint64(1), 1, 0
    while span < k:
        step = min(span, k - span)
        h = h[:, : h.shape[1] - step] * _MIX[turn % len(_MIX)] + h[:, step:]
        h ^= h >> np.uint64(29)
        span, turn = span + step, turn + 1
    h *= _MIX[1]
    return h ^ h >> np.uint64(32)


# ---- blocks --------------------------------------------------------------------------------------


def _bucket_of(number: int, buckets: int) -> int:
    """Spark's bucket of a long: Murmur3 of its two halves, seed 42, modulo the number of buckets."""
    mask, h = 0xFFFFFFFF, 42
    for k in (number & mask, number >> 32 & mask):
        k = k * 0xCC9E2D51 & mask
        k = (k << 15 | k >> 17) & mask
        h ^= k * 0x1B873593 & mask
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    h ^= 8
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return (h - (1 << 32) if h >> 31 else h) % buckets


def _block_ids(task: int, buckets: int) -> Iterator[int]:
    """Numbers of this task's own that all fall into one bucket."""
    number = task << 32
    while True:
        if _bucket_of(number, buckets) == task % buckets:
            yield number
        number += 1


def blocks(docs: DataFrame, buckets: int, size: int = BLOCK) -> DataFrame:
    """block, doc_ids, sizes and the compressed bytes of about ``size`` bytes of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _block_ids(TaskContext.get().partitionId(), buckets)
        ids, texts, held = [], [], 0
        pack = zstandard.ZstdCompressor(level=1)

        def row() -> pa.RecordBatch:
            whole, sizes = b"".join(texts), [len(t) for t in texts]
            counts, offsets = runs(np.frombuffer(whole, np.uint8), np.cumsum(np.array(sizes, np.int64)))
            packed = [pack.compress(x) for x in (whole, counts.tobytes(), offsets.tobytes())]
            columns = [pa.array([next(numbers)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), *(pa.array([x], pa.binary()) for x in packed)]
            return pa.RecordBatch.from_arrays(columns, names=["block", "doc_ids", "sizes", "blob", "counts", "offsets"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode()
                if held and held + len(raw) > size:
                    yield row()
                    ids, texts, held = [], [], 0
                ids.append(doc)
                texts.append(raw)
                held += len(raw)
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "block long, doc_ids array<long>, sizes array<int>, blob binary, counts binary, offsets binary")


class Block:
    """One row of the table of blocks, with its records."""

    def __init__(self, row: dict) -> None:
        unpack = zstandard.ZstdDecompressor().decompress
        self.block, self.raw_ids = row["block"], row["doc_ids"]
        self.ids = np.array([_LAST if d is None else d for d in row["doc_ids"]], np.int64)
        self.raw = unpack(row["blob"])
        self.text = np.frombuffer(self.raw, np.uint8)
        self.ends = np.cumsum(np.array(row["sizes"], np.int64))
        counts, offsets = (np.frombuffer(unpack(row[c]), np.uint8) for c in ("counts", "offsets"))
        self.anchor, self.doc, self.first, self.count = records(self.text, self.ends, counts, offsets)
        self.anchors, self.which = np.unique(self.anchor, return_inverse=True)

    def shard(self, shards: int) -> np.ndarray:
        return (self.anchors % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int64)

    def dealt(self, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The anchors' places by shard, and (shard, begin, end) of each one's part; all shards in one sort, as they grow with the corpus."""
        of = self.shard(shards)
        order = np.argsort(of, kind="stable")
        of = of[order]
        cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
        return order, list(zip(of[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(of)]))

    def shared(self, bits: dict[int, bytes], shards: int) -> np.ndarray:
        """For each record whether another document has its anchor."""
        order, parts = self.dealt(shards)
        found, mark = np.zeros(len(order), bool), np.zeros(len(order), bool)
        for shard, lo, hi in parts:
            if (packed := bits.get(shard)) is not None:
                found[lo:hi] = np.unpackbits(np.frombuffer(packed, np.uint8), count=hi - lo)
        mark[order] = found
        return mark[self.which]

    def stretches(self, shared: np.ndarray, shards: int) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
        """For each shard: its distinct stretches, the smallest id of each, its records and the number of each one's stretch."""
        of = self.shard(shards)[self.which]
        at = np.flatnonzero(shared)
        at = at[np.argsort(of[at], kind="stable")]
        cuts = np.flatnonzero(np.append(True, of[at][1:] != of[at][:-1])) if len(at) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(at)]):
            mine, raw = at[lo:hi], self.raw
            begin = self.first[mine]
            texts = [raw[a:b] for a, b in zip(begin.tolist(), (begin + self.count[mine] + LENGTH - 1).tolist())]
            known = dict.fromkeys(texts)
            for n, text in enumerate(known):
                known[text] = n
            number = np.fromiter(map(known.__getitem__, texts), np.int64, len(texts))
            least = np.full(len(known), _LAST, np.int64)
            np.minimum.at(least, number, self.ids[self.doc[mine]])
            yield int(of[mine[0]]), list(known), least, mine, number


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, dict]]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            yield Block(row), row


def _replies(row: dict) -> dict[int, bytes]:
    return {r["shard"]: r["bits"] for r in row["replies"] or []}


# ---- steps ---------------------------------------------------------------------------------------


def _send_anchors(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in _blocks(batches):
            order, parts = block.dealt(shards)
            # an anchor of two documents of this block needs no other block
            pairs = np.unique(block.which.astype(np.int64) * (len(block.ids) + 1) + block.doc) if len(block.which) else block.which
            several = (np.bincount(pairs // (len(block.ids) + 1), minlength=len(block.anchors)) > 1)[order]
            packed = np.ascontiguousarray(block.anchors[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
            rows = [(shard, block.block, packed[lo:hi].tobytes(), np.packbits(several[lo:hi]).tobytes()) for shard, lo, hi in parts]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["shard", "block", "anchors", "several"])

    return run


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each shard; they come sorted by shard."""
    now: list[dict] = []
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            for row in batch.slice(i, ROWS).to_pylist():
                if now and now[0]["shard"] != row["shard"]:
                    yield now
                    now = []
                now.append(row)
    if now:
        yield now


def _meet_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _shards(batches):
        raw = np.frombuffer(b"".join(row["anchors"] for row in rows), np.uint8).reshape(-1, 6)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :6] = raw
        _, which, counts = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
        shared, at, out = counts[which] > 1, 0, []
        for row in rows:
            own = len(row["anchors"]) // 6
            several = np.unpackbits(np.frombuffer(row["several"], np.uint8), count=own).astype(bool)
            bits = shared[at : at + own] | several
            at += own
            if bits.any():
                out.append((row["block"], row["shard"], np.packbits(bits).tobytes()))
        if out:
            yield _reply(out)


def _reply(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["block", "shard", "bits"])


def _send_stretches(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for block, row in _blocks(batches):
            rows = []
            for shard, texts, least, _, _ in block.stretches(block.shared(_replies(row), shards), shards):
                sizes = np.fromiter(map(len, texts), "<u2", len(texts))
                rows.append((shard, block.block, packer.compress(sizes.tobytes()), packer.compress(least.astype("<i8").tobytes()), packer.compress(b"".join(texts))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["shard", "block", "sizes", "least", "blob"])

    return run


def _meet_stretches(memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for rows in _shards(batches):
            known: dict[bytes, int] = {}
            numbers, leasts = [], []
            for row in rows:
                sizes = np.frombuffer(unpack(row["sizes"]), "<u2").astype(np.int64)
                blob, at = unpack(row["blob"]), 0
                ends = np.cumsum(sizes).tolist()
                own = []
                for end in ends:
                    own.append(known.setdefault(blob[at:end], len(known)))
                    at = end
                numbers.append(np.array(own, np.int64))
                leasts.append(np.frombuffer(unpack(row["least"]), "<i8"))
            least = np.full(len(known), _LAST, np.int64)
            np.minimum.at(least, np.concatenate(numbers), np.concatenate(leasts))
            offset, best = smallest_holder(list(known), least, memory)
            out = []
            for row, own, mine in zip(rows, numbers, leasts):
                counts = offset[own + 1] - offset[own]
                begins = np.cumsum(counts) - counts
                at = np.repeat(offset[own] - begins, counts) + np.arange(counts.sum())
                bits = best[at] < np.repeat(mine, counts)
                out.append((row["block"], row["shard"], np.packbits(bits).tobytes()))
            yield _reply(out)

    return run


def smallest_holder(stretches: list[bytes], least: np.ndarray, memory: int = sx.MEMORY, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For every start of every (distinct) stretch the smallest id that holds the string there.

    Returns where each stretch's starts begin in the second array. Stretches whose anchor no other
    stretch has keep their own id; the others' suffixes are sorted.
    """
    sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
    counts = sizes - length + 1
    offset = np.concatenate(([0], np.cumsum(counts)))
    best = np.repeat(least, counts)
    text = np.frombuffer(b"".join(stretches), np.uint8)
    begins = np.cumsum(sizes) - sizes
    anchor = _anchors_at(text, begins, length)
    _, which, times = np.unique(anchor, return_inverse=True, return_counts=True)
    chosen = np.flatnonzero(times[which] > 1)
    chosen = chosen[np.argsort(which[chosen], kind="stable")]
    if len(chosen):
        # whole anchors, some SORTED bytes at a time
        filled = np.cumsum(sizes[chosen]) // SORTED
        heads = np.flatnonzero(np.append(True, which[chosen][1:] != which[chosen][:-1]))
        cuts = heads[np.flatnonzero(np.diff(filled[heads], prepend=-1))]
        for lo, hi in zip(cuts, [*cuts[1:], len(chosen)]):
            _sorted(text, begins, sizes, counts, offset, chosen[lo:hi], best, memory, length)
    return offset, best


def _sorted(text: np.ndarray, begins: np.ndarray, sizes: np.ndarray, counts: np.ndarray, offset: np.ndarray, chosen: np.ndarray, best: np.ndarray, memory: int, length: int) -> None:
    """Runs of suffixes of the chosen stretches that share ``length`` bytes get their smallest id, in place."""
    # one stretch after another, a separator 0 behind each; symbols are bytes + 1, which UTF-8 leaves room for
    spaced = sizes[chosen] + 1
    starts = np.cumsum(spaced) - spaced
    total = int(spaced.sum())
    joined = sx.array(total, np.uint8 if not len(text) or text.max() < 255 else np.uint16, memory)
    # where in ``best`` each place counts, -1 where fewer than ``length`` bytes follow
    slot = sx.array(total, np.int32 if len(best) < 1 << 31 else np.int64, memory)
    for a in range(0, len(chosen), PART):
        some, at = chosen[a : a + PART], starts[a : a + PART] - starts[a]
        size, end = spaced[a : a + PART], int(starts[a] + spaced[a : a + PART].sum())
        within = np.arange(end - starts[a]) - np.repeat(at, size)
        inside = within < np.repeat(size - 1, size)
        joined[starts[a] : end][inside] = text[(np.repeat(begins[some], size) + within)[inside]].astype(joined.dtype) + 1
        place = np.repeat(offset[some], size) + within
        place[within >= np.repeat(counts[some], size)] = -1
        slot[starts[a] : end] = place
    low, members = _LAST, []

    def close() -> None:
        if len(members) > 1 or (members and len(members[0]) > 1):
            best[np.concatenate(members)] = low

    for positions, lcp in sx.suffixes(joined, length, memory):
        here = slot[positions]
        edges = np.concatenate(([0], np.flatnonzero(lcp < length), [len(here)]))
        if len(edges) > 2 and edges[1] == 0:
            edges = edges[1:]
            close()
            low, members = _LAST, []
        # the first run of the batch continues the open one, the last one stays open
        head = here[edges[0] : edges[1]]
        head = head[head >= 0]
        if len(head):
            members.append(head)
            low = min(low, int(best[head].min()))
        if len(edges) == 2:
            continue
        close()
        groups = np.repeat(np.arange(len(edges) - 3), np.diff(edges[1:-1]))
        middle = here[edges[1] : edges[-2]]
        ok = middle >= 0
        middle, groups = middle[ok], groups[ok]
        if len(middle):
            first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
            best[middle] = np.repeat(np.minimum.reduceat(best[middle], first), np.diff(np.append(first, len(middle))))
        tail = here[edges[-2] :]
        tail = tail[tail >= 0]
        members = [tail] if len(tail) else []
        low = int(best[tail].min()) if len(tail) else _LAST
    close()


def _anchors_at(text: np.ndarray, begins: np.ndarray, length: int, k: int = K) -> np.ndarray:
    """The anchor of the string of ``length`` bytes at each place; the same one that its run has."""
    low, places = np.uint64((1 << _PLACE) - 1), np.zeros(len(begins), np.int64)
    for a in range(0, len(begins), 50_000):
        some = begins[a : a + 50_000]
        keys = _hash_rows(text[some[:, None] + np.arange(length)], k) & ~low | np.arange(length - k + 1, dtype=np.uint64)
        before = (keys.min(axis=1) & low).astype(np.int64)
        places[a : a + 50_000] = some + before - k * (before >= HALF)
    return _anchor_hashes(text, places)


def _cut(shards: int, with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, row in _blocks(batches):
            verdict = {r["shard"]: r["bits"] for r in row["verdicts"] or []}
            removed_starts = [np.zeros(0, np.int64)]
            for shard, texts, least, mine, number in block.stretches(block.shared(_replies(row), shards), shards):
                counts = np.fromiter(map(len, texts), np.int64, len(texts)) - LENGTH + 1
                bits = np.unpackbits(np.frombuffer(verdict[shard], np.uint8), count=int(counts.sum())).astype(bool)
                begins = np.cumsum(counts) - counts
                # a copy of a stretch whose smallest holder is in this block goes as a whole
                later = block.ids[block.doc[mine]] > least[number]
                count, first = counts[number], block.first[mine]
                every = np.repeat(np.cumsum(count) - count, count)
                within = np.arange(int(count.sum())) - every
                hit = bits[np.repeat(begins[number], count) + within] | np.repeat(later, count)
                removed_starts.append((np.repeat(first, count) + within)[hit])
            start = np.concatenate(removed_starts)
            change = np.bincount(start, minlength=len(block.text) + 1) - np.bincount(start + LENGTH, minlength=len(block.text) + 1)
            removed = np.cumsum(change[:-1]) > 0
            rows = []
            begin = 0
            for doc, end in zip(block.raw_ids, block.ends.tolist()):
                gone = removed[begin:end]
                edge = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
                starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                kept = block.text[begin:end][~gone].tobytes() if len(starts) else block.raw[begin:end]
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(starts, ends)]
                rows.append((doc, end - begin, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
                begin = end
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])

    return run


def deduplicate(docs: DataFrame, with_bytes: bool = True, block: int = BLOCK, shard: int = SHARD, bucket: int = BUCKET, memory: int = sx.MEMORY) -> DataFrame:
    """doc_id, n_bytes, n_removed, the removed spans (bytes), the digest and, if asked, the bytes that remain."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    shards, buckets = max(1, math.ceil(total / shard)), max(1, math.ceil(total / bucket))
    name, path = scratch_table(spark, "blocks")
    packed = blocks(docs, buckets, block).write.bucketBy(buckets, "block").option("compression", "none")
    packed.option("path", path).saveAsTable(name)
    stored = spark.table(name)

    def met(sent: DataFrame, at) -> DataFrame:
        return sent.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard").mapInArrow(at, "block long, shard long, bits binary")

    sent = stored.mapInArrow(_send_anchors(shards), "shard long, block long, anchors binary, several binary")
    replies = _kept(_by_block(met(sent, _meet_anchors), "replies"))
    with_replies = stored.join(replies.hint("merge"), "block", "left")
    sent = with_replies.mapInArrow(_send_stretches(shards), "shard long, block long, sizes binary, least binary, blob binary")
    verdicts = _kept(_by_block(met(sent, _meet_stretches(memory)), "verdicts"))
    final = with_replies.join(verdicts.hint("merge"), "block", "left")
    out = final.mapInArrow(_cut(shards, with_bytes), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary")
    return out if with_bytes else out.drop("kept")


def _by_block(replies: DataFrame, name: str) -> DataFrame:
    """One row a block: at most one reply from each shard, some bits for every record."""
    return replies.groupBy("block").agg(F.collect_list(F.struct("shard", "bits")).alias(name))


def _kept(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "replies")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = deduplicate(docs, with_bytes=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
