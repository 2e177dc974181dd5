"""SimHash near-duplicate classes, searched through tables of distances to pivots.

``fingerprints``: words of the ASCII-lower-cased text, shingles of ``width`` words, XXH64 of each,
bitwise majority. ``link``: classes of fingerprints within ``radius`` bits, transitively.

Search. A 64-bit code is cut into ``radius + n`` segments; codes within ``radius`` bits agree on n
segments at least, so every pair meets in one of C(segments, n) buckets (an exact blocking: distances
to a pivot concentrate around 32, so pivots alone would leave almost every pair of a large table).
n is the least from 2 on for which a bucket of evenly spread codes holds at most ``FILL``: with 4 bits
a key has some 21 bits and 15 buckets, 27 and 35 beyond 134 million codes, 32 and 70 beyond 8 billion.
The result is the same for every n; only the number of comparisons changes.
Within a bucket each code has a row of Hamming distances to ``PIVOTS`` fixed references. Rows are
sorted by the first distance; a pair is discarded as soon as the largest coordinate difference exceeds
``radius`` (triangle inequality, so nothing is lost) and survivors are verified by the bit count.

Scale. Equal fingerprints fold to one row first. A bucket of more than ``CHUNK`` codes is cut into
chunks and the pairs of chunks are dealt to separate groups, so no task holds more than two chunks.
Tasks emit a spanning forest of the links they find, never all pairs.

Defined results: null text is an empty text; no word gives fingerprint zero, linked like any other;
repeated rows give repeated output rows; a null doc_id gets a fingerprint and its class's smallest
doc_id, null if the class has none; extra columns are ignored; an empty table gives an empty result.
Ids from 2**63 - 2**40 on stand for classes without a doc_id and are not accepted as true ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.functions.shared import checkpointed, fresh, texts_of
from veldspar.operators.components import connected_components

BITS = 64
PIVOTS = 16
CHUNK = 2048
FILL = 64
#: Groups up to this size are compared together, larger ones one by one.
SMALL = 24
_UNNAMED = (1 << 63) - 1


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [hashed(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [hashed(joined[s:e], seed) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
    return majority(np.array(hashes, dtype="<u8"))


def majority(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """Bits set in over half of the hashes; long inputs are counted block by block."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), block):
        part = hashes[at : at + block]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint (signed 64-bit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width, seed) for t in texts_of(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def link(prints: DataFrame, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id of every row of ``prints`` (doc_id, fp)."""
    prints = checkpointed(prints)
    # A class without any doc_id still links; its stand-in id sorts after every true one.
    codes = checkpointed(
        prints.groupBy("fp").agg(F.min("doc_id").alias("own"))
        .select("fp", F.coalesce("own", F.lit(_UNNAMED) - F.expr("fp & 1099511627775")).alias("node"))
    )
    classes = connected_components(links(codes, radius))
    named = checkpointed(
        codes.join(classes, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
        .select("fp", F.when(F.col("component") < _UNNAMED - (1 << 40), F.col("component")).alias("component_id"))
    )
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def links(codes: DataFrame, radius: int = 4, equal: int | None = None) -> DataFrame:
    """Edges (a, b) of a spanning forest of the links between distinct codes (fp, node).

    ``equal``: segments that make a key, by default as many as the number of codes asks for.
    """
    equal = equal or _equal(codes.count(), radius)
    keyed = codes.select("fp", "node", F.explode(_buckets("fp", radius, equal)).alias("bucket"))
    hot = checkpointed(
        keyed.groupBy("bucket").count().where(F.col("count") > CHUNK)
        .select("bucket", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    )
    dealt = keyed.join(hot, "bucket", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("bucket", "fp", "node", F.coalesce(own, F.lit(0)).alias("own"), other.alias("other"))
    group = F.xxhash64("bucket", "lo", "hi")  # a clash only adds comparisons
    dealt = dealt.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp", "node")
    dealt = dealt.repartition(F.col("bucket"), F.col("lo"), F.col("hi")).withColumn("grp", group).drop("lo", "hi", "bucket").sortWithinPartitions("grp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, fp, node in _whole_groups(batches):
            yield from _forest(grp, fp, node, radius)

    return dealt.select("grp", "fp", "node").mapInArrow(run, "a long, b long").distinct()


def _cuts(radius: int, equal: int) -> list[int]:
    return [round(i * BITS / (radius + equal)) for i in range(radius + equal + 1)]


def _equal(codes: int, radius: int) -> int:
    """The least number of equal segments whose keys leave at most ``FILL`` evenly spread codes in a bucket, 2 to 6."""
    for equal in range(2, 6):
        if codes >> equal * BITS // (radius + equal) <= FILL:
            return equal
    return 6


def _buckets(fp: str, radius: int, equal: int = 2):
    """One bucket id for each choice of ``equal`` segments: a hash of the choice's number and the segments' bits (a clash only adds comparisons)."""
    cuts = _cuts(radius, equal)
    pieces = [F.shiftrightunsigned(F.col(fp), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:])]
    return F.array(*[F.xxhash64(F.lit(number), *chosen) for number, chosen in enumerate(combinations(pieces, equal))])


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays that end at group ends; the rows come sorted by group, so the rest waits for the next batch."""
    held: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]))
        rows += batch.num_rows
        if rows < least:
            continue
        whole = np.concatenate(held, axis=1)
        cut = int(np.searchsorted(whole[0], whole[0, -1], "left"))
        if cut:
            yield whole[0, :cut], whole[1, :cut], whole[2, :cut]
        held, rows = [whole[:, cut:]], whole.shape[1] - cut
    if held:
        whole = np.concatenate(held, axis=1)
        if whole.shape[1]:
            yield whole[0], whole[1], whole[2]


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The fixed reference codes."""
    return np.random.default_rng(20_240_601).integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)


def _forest(grp: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """Links found within the groups, as edges to the smallest node of each local class."""
    codes = fp.view(np.uint64)
    first = np.bitwise_count(codes ^ pivots(1)[0])
    order = np.lexsort((first, grp))
    grp, codes, node = grp[order], codes[order], node[order]
    begins = np.flatnonzero(np.concatenate(([True], grp[1:] != grp[:-1])))
    sizes = np.diff(np.append(begins, len(grp)))
    few = (sizes > 1) & (sizes <= SMALL)
    if few.any():
        mask = np.repeat(few, sizes)
        yield _edges(grp[mask], codes[mask], node[mask], int(sizes[few].max()), radius)
    for at, size in zip(begins[sizes > SMALL], sizes[sizes > SMALL]):
        yield _edges(grp[at : at + size], codes[at : at + size], node[at : at + size], int(size), radius)


def _edges(grp: np.ndarray, codes: np.ndarray, node: np.ndarray, longest: int, radius: int) -> pa.RecordBatch:
    """Rows are sorted by group and distance to the first pivot: row i is compared with i + 1, i + 2, ...

    until the first coordinate differs by more than the radius; pairs already joined are skipped.
    """
    table = np.bitwise_count(codes[:, None] ^ pivots()[None, :]).astype(np.int16)
    label = np.arange(len(codes))
    live = np.arange(len(codes))
    for step in range(1, longest):
        live = live[live + step < len(codes)]
        near = live + step
        live = live[(grp[near] == grp[live]) & (table[near, 0] - table[live, 0] <= radius)]
        if not len(live):
            break
        i = live[label[live] != label[live + step]]
        j = i + step
        keep = np.abs(table[i] - table[j]).max(axis=1, initial=0) <= radius
        i, j = i[keep], j[keep]
        keep = np.bitwise_count(codes[i] ^ codes[j]) <= radius
        if keep.any():
            _join(label, i[keep], j[keep])
    low = node.copy()
    np.minimum.at(low, label, node)
    low = low[label]
    out = low != node
    return pa.RecordBatch.from_arrays([pa.array(node[out]), pa.array(low[out])], names=["a", "b"])


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the classes of i and j in place; every label is a root."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            shorter = label[label]
            if np.array_equal(shorter, label):
                break
            label[:] = shorter


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row."""
    found = link(fingerprints(docs, width, seed), radius)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` without near duplicates: of each class the row with the smallest doc_id stays, with all its columns.

    Rows that share a doc_id count as one document, of which one row stays. A row without a doc_id cannot
    be named as a copy and stays. The texts are shuffled once, by doc_id; there is no hot key.
    """
    (name,) = fresh(docs, "kept")
    found = checkpointed(link(fingerprints(docs, width, seed), radius))
    ids = found.where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(ids, F.col("doc_id") == F.col(name), "left_semi")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))
