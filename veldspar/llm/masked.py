"""Masked pseudo-likelihood: every token predicted from both sides by a small window network.

* Vocabulary: every word of the whole corpus, counted in a distributed pass. The network tells the most
  frequent words and ``BUCKETS`` hash buckets of all others apart; ids fall into two digits, frequent words
  together. A word of a bucket has its share of the bucket's count:
  ln P(word | around) = ln P(bucket | around) + ln(n of the word / (n of the bucket + 1)); the 1 is the
  part of words that the corpus lacks.
* Network: embeddings of the ``SIDE`` words on each side, a tanh layer, and a softmax for each digit
  of the masked word (the second one also sees the first digit). Trained in numpy.
* Training covers every token of the corpus once: each task trains a replica from the same start on
  its own documents (minibatches, Adagrad); the replicas' parameters are averaged by tokens.
* Score: the sum over a document's tokens of ln P(token | the words around it).

Scale. Three narrow passes over the text (count, train, score). Shuffled: each task's distinct words
with counts; each task's parameters, cut into ``SLICES`` rows that are averaged by as many tasks one
by one; and the rare words of each document, which are joined to their counts. The counts grow with the
corpus and stay distributed; the driver and each task hold ``WORDS`` words, the counts of at most
``COMMON`` further ones, which spares their tokens the join and keeps hot keys out of it, and one set of
parameters. A task also holds a batch of documents and the words of ``CUT`` bytes of them.

Defined results: a null or empty text has no tokens and scores 0 (mean null); words are runs of bytes
that are not ASCII white space, in lower-case ASCII; repeated rows give repeated output rows; a null
doc_id stays null; extra columns are ignored; an empty table gives an empty result (and an untrained
network). Replicas follow the input's partitions, so scores depend on them in the last digits.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.functions.shared import checkpointed

#: Ids: DIGIT squared; 0 is outside the text, then WORDS words, then the buckets of all others.
DIGIT = 32
WORDS = 767
BUCKETS = DIGIT * DIGIT - 1 - WORDS
SIDE, WIDTH, HIDDEN = 2, 8, 16
BATCH, RATE = 1024, 0.1
SLICES = 8
COUNTED = 200_000
#: Words after the first WORDS whose counts are looked up in the tasks; all others are joined.
COMMON = 200_000
#: Bands of counts for each doubling, from which the common words are taken whole.
BANDS = 8
#: Tokens that are held as arrays at a time.
HELD = 1 << 18
#: Bytes of text that are cut into words at a time.
CUT = 1 << 22


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


class Vocabulary(dict):
    """Word to id: the listed words by rank, any other by its hash (remembered while there is room).

    For the words of the buckets: the count of each bucket, the words with counts that the tasks look up,
    and the table of the other words with counts of two and more.
    """

    def __init__(self, words: list[bytes], totals: np.ndarray | None = None, common: dict[bytes, int] | None = None, rare: DataFrame | None = None) -> None:
        super().__init__((w, n + 1) for n, w in enumerate(words))
        self.words = words
        self.totals = np.zeros(BUCKETS) if totals is None else totals
        self.common = common or {}
        self.rare = rare

    def __missing__(self, word: bytes) -> int:
        found = 1 + WORDS + zlib.crc32(word) % BUCKETS
        if len(self) < COUNTED:
            self[word] = found
        return found

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


class Network:
    """Parameters as one flat float32 vector with named views."""

    SHAPES = {"e": (DIGIT * DIGIT, WIDTH), "w": (2 * SIDE * WIDTH, HIDDEN), "b": (HIDDEN,), "o": (HIDDEN, 2 * DIGIT), "c": (2 * DIGIT,), "d": (DIGIT, DIGIT)}
    SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray | None = None, seed: int = 1) -> None:
        if flat is None:
            flat = np.random.default_rng(seed).normal(0, 0.1, self.SIZE).astype(np.float32)
        self.flat = np.array(flat, np.float32)
        self.sums = np.full(self.SIZE, 1e-3, np.float32)
        self.view, at = {}, 0
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            self.view[name] = self.flat[at : at + size].reshape(shape)
            at += size

    def _forward(self, around: np.ndarray, hi: np.ndarray, lo: np.ndarray):
        """Classes and hidden units are rows and tokens columns: maxima and sums over classes are then sums of rows."""
        v, each = self.view, np.arange(len(hi))
        x = v["e"].take(around.ravel(), axis=0).reshape(len(hi), 2 * SIDE * WIDTH)
        z = v["w"].T @ x.T
        z += v["b"][:, None]
        np.tanh(z, out=z)
        out = v["o"].T @ z
        out += v["c"][:, None]
        out[DIGIT:] += v["d"].take(hi, axis=0).T
        pair = out.reshape(2, DIGIT, -1)
        pair -= pair.max(axis=1, keepdims=True)
        chosen = pair[0, hi, each] + pair[1, lo, each]
        np.exp(pair, out=pair)
        total = pair.sum(axis=1)
        return x, z, pair, total, chosen - np.log(total).sum(axis=0)

    def score(self, around: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """ln P of each id given the ids around it."""
        return self._forward(around, ids // DIGIT, ids % DIGIT)[4]

    def learn(self, around: np.ndarray, ids: np.ndarray) -> None:
        n, each, v = len(ids), np.arange(len(ids)), self.view
        hi, lo = ids // DIGIT, ids % DIGIT
        x, z, pair, total, _ = self._forward(around, hi, lo)
        pair /= (total * n)[:, None]
        pair[0, hi, each] -= 1 / n
        pair[1, lo, each] -= 1 / n
        g = pair.reshape(2 * DIGIT, n)
        gz = (v["o"] @ g) * (1 - z * z)
        gx = (v["w"] @ gz).reshape(2 * SIDE, WIDTH, n)
        at = around.T.ravel().astype(np.intp)
        ge = np.empty((DIGIT * DIGIT, WIDTH))
        for k in range(WIDTH):
            ge[:, k] = np.bincount(at, gx[:, k].ravel(), DIGIT * DIGIT)
        firsts, ones = np.eye(DIGIT, dtype=np.float32).take(hi, axis=0), np.ones(n, np.float32)
        grads = [ge.ravel(), (x.T @ gz.T).ravel(), gz @ ones, (z @ g.T).ravel(), g @ ones, (g[DIGIT:] @ firsts).T.ravel()]
        grad = np.concatenate(grads, dtype=np.float32, casting="same_kind")
        self.sums += grad * grad
        self.flat -= RATE * grad / np.sqrt(self.sums)


def windows(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of some documents, and the SIDE ids on each side of each (0 outside its document)."""
    gap = np.zeros(SIDE, np.int32)
    line = np.concatenate([p for i in ids for p in (gap, i)] + [gap]) if ids else gap
    at, place = [], SIDE
    for i in ids:
        at.append(np.arange(place, place + len(i)))
        place += len(i) + SIDE
    where = np.concatenate(at) if at else np.zeros(0, int)
    near = [o for o in range(-SIDE, SIDE + 1) if o]
    return line[where], np.stack([line[where + o] for o in near], axis=1) if len(where) else np.zeros((0, 2 * SIDE), np.int32)


def _cut(column: pa.Array) -> Iterator[tuple[pa.DictionaryArray, np.ndarray]]:
    """The words of some texts, some ``CUT`` bytes at a time, and how many each text has; the same words as ``split``'s.

    A dictionary has each word of these texts once, so that tables of words are asked once for each.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, CUT + (ends[at - 1] if at else 0), "right")))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.slice(at, to - at), "")))
        words, bounds = lists.flatten(), lists.offsets.to_numpy()
        filled = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves an empty word there
        before = np.concatenate(([0], np.cumsum(filled.to_numpy(zero_copy_only=False))))
        if before[-1] < len(words):
            words = words.filter(filled)
        yield words.dictionary_encode(), np.diff(before[bounds - bounds[0]])
        at = to


def _documents(column: pa.Array, ids_of: Callable[[list[bytes]], np.ndarray]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """For each text the different words around, the places of its own among them, and its ids."""
    for words, sizes in _cut(column):
        kinds, places = words.dictionary.cast(pa.large_binary()).to_pylist(), words.indices.to_numpy()
        ids, at = ids_of(kinds).take(places), 0
        for to in np.cumsum(sizes).tolist():
            yield kinds, places[at:to], ids[at:to]
            at = to


def _held(texts: Iterator[tuple[list[bytes], np.ndarray, np.ndarray]], most: int = HELD) -> Iterator[list[tuple[list[bytes], np.ndarray, np.ndarray]]]:
    """Documents, some ``most`` tokens at a time; a longer document comes alone."""
    now, size = [], 0
    for text in texts:
        if now and size + len(text[2]) > most:
            yield now
            now, size = [], 0
        now.append(text)
        size += len(text[2])
    if now:
        yield now


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def counts(docs: DataFrame, most: int = COUNTED) -> DataFrame:
    """word (binary) and n over the whole corpus; tasks send on ``most`` words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, _ in _cut(batch.column(1)):
                found = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                whole = pa.RecordBatch.from_arrays([words.dictionary.cast(pa.binary()), pa.array(found, pa.int64())], names=["word", "n"])
                yield from (whole.slice(at, most) for at in range(0, len(whole), most))

    return _texts(docs).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Places(dict):
    """Word to place: ids of the listed words, then the common words, then the buckets of the rare ones."""

    def __init__(self, listed: list[bytes], common: dict[bytes, int], totals: np.ndarray) -> None:
        super().__init__((w, n + 1) for n, w in enumerate(listed))
        self.rare = 1 + WORDS + len(common)
        self.update((w, 1 + WORDS + n) for n, w in enumerate(common))
        self.most = len(self) + COUNTED
        buckets = np.fromiter((zlib.crc32(w) % BUCKETS for w in common), np.int32, len(common))
        self.ids = np.concatenate([np.arange(1 + WORDS), 1 + WORDS + buckets, 1 + WORDS + np.arange(BUCKETS)]).astype(np.int32)
        # ln of the word's share; of a rare word that of a count of 1, to which the join adds ln n
        whole = np.log(totals + 1)
        self.shares = np.concatenate([np.zeros(1 + WORDS), np.log(np.fromiter(common.values(), float, len(common))) - whole[buckets], -whole])

    def __missing__(self, word: bytes) -> int:
        found = self.rare + zlib.crc32(word) % BUCKETS
        if len(self) < self.most:
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def vocabulary(docs: DataFrame) -> Vocabulary:
    known = checkpointed(counts(docs))
    listed = {bytes(r.word): r.n for r in known.orderBy(F.desc("n"), "word").limit(WORDS).collect()}
    totals = np.zeros(BUCKETS)
    for r in known.groupBy((F.crc32("word") % BUCKETS).alias("bucket")).agg(F.sum("n").alias("n")).collect():
        totals[r.bucket] = r.n
    for word, n in listed.items():
        totals[zlib.crc32(word) % BUCKETS] -= n
    # Whole bands of counts, from the top, while their words fit; a few hundred bands for any corpus.
    band = F.floor(F.log2("n") * BANDS)
    room, least = COMMON + len(listed), None
    for r in known.where("n > 1").groupBy(band.alias("band")).agg(F.count("*").alias("words")).orderBy(F.desc("band")).collect():
        room -= r.words
        if room < 0:
            break
        least = r.band
    above = known.where("n > 1").where(F.lit(False) if least is None else band >= least).toArrow()
    common = {w: n for w, n in zip(above["word"].to_pylist(), above["n"].to_pylist()) if w not in listed}
    rare = known.where("n > 1").where(F.lit(True) if least is None else band < least)
    return Vocabulary(list(listed), totals, common, rare)


def train(docs: DataFrame, words: Vocabulary) -> Network:
    """The average, by tokens, of a replica for each input partition."""
    listed = words.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, net, tokens = Vocabulary(listed), Network(), 0
        for held in _held(text for b in batches for text in _documents(b.column(1), known.ids)):
            ids, around = windows([ids for *_, ids in held])
            order = np.random.default_rng(tokens).permutation(len(ids))
            for at in range(0, len(ids), BATCH):
                some = order[at : at + BATCH]
                net.learn(around.take(some, axis=0), ids.take(some))
            tokens += len(ids)
        if tokens:
            parts = np.array_split(net.flat.astype("<f4"), SLICES)
            columns = [pa.array(range(SLICES), pa.int32()), pa.array([tokens] * SLICES, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["slice", "tokens", "part"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                now = sums.setdefault(row["slice"], [0, 0.0])
                now[0] += row["tokens"]
                now[1] = now[1] + row["tokens"] * np.frombuffer(row["part"], "<f4").astype(float)
        rows = [(k, (total / n).astype("<f4").tobytes()) for k, (n, total) in sums.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["slice", "part"])

    replicas = _texts(docs).mapInArrow(run, "slice int, tokens long, part binary")
    found = checkpointed(replicas.repartition(SLICES, "slice").mapInArrow(average, "slice int, part binary")).collect()
    if not found:
        return Network()
    return Network(np.concatenate([np.frombuffer(r.part, "<f4") for r in sorted(found)]))


def score(docs: DataFrame, words: Vocabulary, net: Network) -> DataFrame:
    """doc_id, n_tokens, pll (sum of ln P) and mean_pll of every row."""
    listed, common, totals, flat = words.words, words.common, words.totals, net.flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, trained = Places(listed, common, totals), Network(flat)
        for batch in batches:
            sums, sizes, rare = [], [], []
            for held in _held(_documents(batch.column(1), known.of)):
                for kinds, words, places in held:
                    rare.append([kinds[i] for i in words[places >= known.rare].tolist()])
                lengths = [len(places) for *_, places in held]
                ids, around = windows([known.ids[places] for *_, places in held])
                found = np.concatenate([trained.score(around[a : a + BATCH], ids[a : a + BATCH]) for a in range(0, len(ids), BATCH)] or [np.zeros(0)])
                found = found + known.shares[np.concatenate([places for *_, places in held])]
                ends = np.cumsum(lengths)
                running = np.concatenate(([0.0], np.cumsum(found, dtype=float)))
                sums += (running[ends] - running[ends - lengths]).tolist()
                sizes += lengths
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), pa.array(rare, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "pll", "rare"])

    rows = _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, pll double, rare array<binary>")
    mean = F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")).alias("mean_pll")
    if words.rare is None:
        return rows.select("doc_id", "n_tokens", "pll", mean)
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", F.explode("rare").alias("word")).join(words.rare, "word")  # a word met once adds ln 1
    added = each.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_tokens"), F.log("n").alias("pll"))
    both = rows.select("row", "doc_id", "n_tokens", "pll").unionByName(added)
    out = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("pll").alias("pll"))
    return out.select("doc_id", "n_tokens", "pll", mean)


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    words = vocabulary(docs)
    return score(docs, words, train(docs, words))
