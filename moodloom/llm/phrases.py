"""Phrase collocations from counting quotient filters.

Texts are cut into runs of one language, and each run numbers its own words. Words that are frequent in their language get
dense numbers over all data; the others end a phrase, since every part of a frequent phrase is at least as frequent. A
run's words meet the numbered ones in a join of (run, word) rows, so no task holds the vocabulary.

An n-gram is its word numbers packed into one key, permuted invertibly. The key's leading bits pick a shard, the next ones are
the quotient, which is not stored but counted per slot, and the rest is the full remainder: sorted keys become a compact,
lossless filter with a counter beside each key. Tasks count into sorted filters of bounded size; filters of a shard
are merged in one task, and shards are as many as the words of the corpus ask for. N-grams of three and four words are counted
in a second pass, where a bit table of the frequent pairs, of bounded size, leaves out most of what cannot be
frequent; false hits there cost time only. Merged counters are unpermuted to word numbers again.

Null texts are empty, a null language is `und`. Repeated rows count once each. Equal scores and counts are ordered by
the phrase's bytes. An empty table gives no rows. Any further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

LEAST, MOST_WORDS, BEST, SHARE = 30, 4, 2000, 80
#: Bytes of text in a run, keys that a task holds before it hands on its filters, and n-grams that a shard may get.
RUN, HELD, SHARD = 8 << 20, 1 << 21, 1 << 21
#: Bits of the table of frequent pairs: 2^27, 16 MB, at most.
TABLE_BITS = 27
U = np.uint64
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
APART = BREAK.copy()
APART[[0x20, 0x09]] = True


# --- words ---

def words_of(body: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts, A-Z lowered, and whether each begins a piece."""
    starts, ends, before = c.spans_of_words(body, at, APART)
    words = c.words_array(FOLD[body], starts, ends, APART)
    breaks = np.concatenate([[0], np.cumsum(BREAK[body])])
    first = np.ones(len(starts), bool)
    first[1:] = breaks[starts[1:]] != breaks[ends[:-1]]
    heads = before[:-1]
    first[heads[heads < len(starts)]] = True
    return words, first


def runs_of(docs: DataFrame) -> DataFrame:
    """Runs of one language: their distinct words with counts, and the text as numbers of these (twice the number, plus one where a piece begins)."""
    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            own = lang.indices.to_numpy()
            for k, name in enumerate(lang.dictionary.to_pylist()):
                rows = pa.RecordBatch.from_arrays([batch.column("text").filter(pa.array(own == k))], ["text"])
                for _, body, at in c.pieces_of([rows], limit=RUN):
                    words, first = words_of(body, at)
                    if not len(words):
                        continue
                    coded = words.dictionary_encode()
                    local = coded.indices.to_numpy().astype(np.int64)
                    counts = np.bincount(local, minlength=len(coded.dictionary))
                    codes = (local << 1) | first
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([(part << 32) | number]), pa.array([name], pa.string()), pa.array([len(words)]), _one(coded.dictionary.cast(pa.binary())),
                         _one(pa.array(counts)), pa.array([codes.astype("<u4").tobytes()], pa.binary())],
                        ["run", "lang", "n", "words", "counts", "codes"])
                    number += 1

    return rows.mapInArrow(run, "run long, lang string, n long, words array<binary>, counts array<long>, codes binary")


def _one(values: pa.Array) -> pa.Array:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def numbered(runs: DataFrame, least: int) -> DataFrame:
    """(lang, word, id, f) of words that occur `least` times in their language; ids are dense, from 1."""
    words = runs.select("lang", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("f"))))
    often = c.settle(words.groupBy("lang", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "often")
    placed = c.settle(often.withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33)
    # One row per part of the table just written, not per word.
    parts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    begins = parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("begin"))
    ids = F.col("begin") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return c.settle(placed.withColumn("part", part).join(begins, "part").select("lang", "word", ids.alias("id"), "f"), "vocabulary")


def coded(runs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The runs as numbers of the vocabulary, 0 for words outside it (again doubled, plus one where a piece begins)."""
    own = runs.select("run", "lang", F.posexplode("words").alias("at", "word")).join(vocabulary.select("lang", "word", "id"), ["lang", "word"])
    maps = own.groupBy("run").agg(F.collect_list(F.struct("at", "id")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes = np.frombuffer(batch.column("codes")[i].as_buffer(), "<u4")
                at, ids = (x.to_numpy() for x in batch.column("ids")[i].values.flatten())
                names = np.zeros(int(codes.max() >> 1) + 1, np.int64)
                names[at] = ids
                yield pa.RecordBatch.from_arrays([pa.array([((names[codes >> 1] << 1) | (codes & 1)).astype("<u8" if ids.max() >> 30 else "<u4").tobytes()], pa.binary()),
                                                  pa.array([8 if ids.max() >> 30 else 4], pa.int32())], ["codes", "width"])

    return runs.select("run", "codes").join(maps, "run").select("codes", "ids").mapInArrow(run, "codes binary, width int")


# --- keys and filters ---

class Packing:
    """Keys of `size` word numbers of `bits` bits: two halves, scrambled by four rounds that can be undone."""

    def __init__(self, size: int, bits: int):
        self.size, self.bits = size, bits
        self.half = -(-size * bits // 2)
        self.mask = U((1 << self.half) - 1)
        self.width = 2 * self.half

    def _round(self, x: np.ndarray, n: int) -> np.ndarray:
        return c.mixed(x + U((n + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & self.mask

    def keys(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Leading and trailing half of each key."""
        left, right = np.zeros(len(words[0]), U), np.zeros(len(words[0]), U)
        for w in words:
            # Shift both halves as one number.
            w = w.astype(U)
            left = ((left << U(self.bits)) | (right >> U(self.half - self.bits) if self.half > self.bits else right << U(self.bits - self.half))) & self.mask
            right = ((right << U(self.bits)) | w) & self.mask
        for n in range(4):
            left, right = right, left ^ self._round(right, n)
        return left, right

    def words(self, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        for n in range(3, -1, -1):
            left, right = right ^ self._round(left, n), left
        out, mask = [], U((1 << self.bits) - 1)
        for _ in range(self.size):
            out.append((right & mask).astype(np.int64))
            carry = (left << U(self.half - self.bits)) & self.mask
            right, left = (right >> U(self.bits)) | carry, left >> U(self.bits)
        return out[::-1]


def counted(left: np.ndarray, right: np.ndarray, counts: np.ndarray, packing: Packing) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys with their counts added up."""
    if not len(left):
        return left, right, counts
    if packing.width <= 64:
        joint = (left << U(packing.half)) | right if packing.half < 64 else left
        order = np.argsort(joint)
        joint = joint[order]
        heads = np.flatnonzero(np.concatenate([[True], joint[1:] != joint[:-1]]))
        return joint[heads] >> U(packing.half), joint[heads] & packing.mask, np.add.reduceat(counts[order], heads)
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    heads = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
    return left[heads], right[heads], np.add.reduceat(counts[order], heads)


def _bytes_of(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _numbers(data: bytes, width: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(n, width)
    return out.reshape(-1).view("<u8").astype(U)


def _small(values: np.ndarray) -> tuple[bytes, int]:
    """Counts in as few bytes each as the largest one needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return _bytes_of(values.astype(U), width), width


def to_filter(left: np.ndarray, right: np.ndarray, counts: np.ndarray, packing: Packing, shard_bits: int) -> bytes:
    """Sorted distinct keys of one shard as a filter: keys per quotient, remainders, counters."""
    n = len(left)
    bits = min(n.bit_length(), packing.half - shard_bits)
    rest = packing.half - shard_bits - bits
    leading = left & U((1 << (packing.half - shard_bits)) - 1)
    slots, slot_width = _small(np.bincount((leading >> U(rest)).astype(np.int64), minlength=1 << bits))
    leading &= U((1 << rest) - 1)
    # The remainder: what is left of the leading half, then the trailing one, in whole bytes together where they fit.
    if rest + packing.half <= 64:
        parts = [((leading << U(packing.half)) | right if packing.half < 64 else right, rest + packing.half)]
    else:
        parts = [(leading, rest), (right, packing.half)]
    remainders = b"".join(_bytes_of(v, (w + 7) // 8) for v, w in parts)
    # Counters of one byte; larger ones stand apart.
    large = np.flatnonzero(counts > 254)
    small = np.where(counts > 254, 255, counts).astype(np.uint8).tobytes()
    head = np.array([n, bits, slot_width, len(large)], "<i8").tobytes()
    return head + slots + remainders + small + large.astype("<i8").tobytes() + counts[large].astype("<i8").tobytes()


def from_filter(data: bytes, packing: Packing, shard_bits: int, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, bits, slot_width, large = np.frombuffer(data, "<i8", 4).tolist()
    rest, at = packing.half - shard_bits - bits, 32
    slots = _numbers(data[at:], slot_width, 1 << bits).astype(np.int64)
    at += slot_width << bits
    quotient = np.repeat(np.arange(1 << bits, dtype=U), slots)
    widths = [rest + packing.half] if rest + packing.half <= 64 else [rest, packing.half]
    parts = []
    for w in widths:
        parts.append(_numbers(data[at:], (w + 7) // 8, n))
        at += n * ((w + 7) // 8)
    if len(parts) == 1:
        leading, right = (parts[0] >> U(packing.half) if packing.half < 64 else parts[0] * U(0)), parts[0] & packing.mask
    else:
        leading, right = parts
    left = (U(shard) << U(packing.half - shard_bits)) | (quotient << U(rest)) | leading
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    at += n
    where = np.frombuffer(data, "<i8", large, at)
    counts[where] = np.frombuffer(data, "<i8", large, at + 8 * large)
    return left, right, counts


def _grams(codes: np.ndarray, size: int, table: np.ndarray | None) -> list[np.ndarray]:
    """Word numbers of all n-grams of a run whose words are numbered and in one piece, and whose pairs may be frequent."""
    ids, first = (codes >> codes.dtype.type(1)).astype(np.int64), (codes & codes.dtype.type(1)).astype(bool)
    n = len(ids) - size + 1
    if n <= 0:
        return [np.zeros(0, np.int64)] * size
    pair = (ids[1:] > 0) & (ids[:-1] > 0) & ~first[1:]
    if table is not None:
        at = np.flatnonzero(pair)
        pair[at] = _listed(table, ids[at], ids[at + 1])
    ok = pair[:n].copy()
    for k in range(1, size - 1):
        ok &= pair[k:k + n]
    at = np.flatnonzero(ok)
    return [ids[at + k] for k in range(size)]


def _slot(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    return c.mixed(c.mixed(x.astype(U)) + y.astype(U) * U(0xA0761D6478BD642F)) >> U(64 - bits)


def _listed(table: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    slot = _slot(x, y, (8 * len(table)).bit_length() - 1)
    return (table[(slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8)) & 1 == 1


def bit_table(pairs: DataFrame, n: int) -> np.ndarray:
    """Bits set for pairs (w1, w2), eight for each of n pairs or as many as 2^TABLE_BITS; a task sets the bits of its blocks."""
    bits = min(TABLE_BITS, max(10, (8 * n).bit_length()))
    block = min(bits, 19)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.unique(_slot(batch.column("w1").to_numpy(), batch.column("w2").to_numpy(), bits)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((slot >> block).astype(np.int32)), pa.array((slot & ((1 << block) - 1)).astype(np.int32))], ["block", "bit"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            blocks, bit = batch.column("block").to_numpy(), batch.column("bit").to_numpy()
            for b in np.unique(blocks).tolist():
                held.setdefault(b, np.zeros(1 << block, bool))[bit[blocks == b]] = True
        for b, flags in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), c.binary([np.packbits(flags, bitorder="little").tobytes()])], ["block", "bits"])

    # 2^TABLE_BITS bits at most, whatever the corpus.
    parts = pairs.select("w1", "w2").mapInArrow(slots, "block int, bit int").repartition("block").mapInArrow(fill, "block int, bits binary")
    table = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts.toLocalIterator():
        table[r["block"] << (block - 3):(r["block"] + 1) << (block - 3)] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return table


def grams(texts: DataFrame, sizes: tuple[int, ...], bits: int, shard_bits: int, least: int, table: np.ndarray | None = None) -> DataFrame:
    """(w1 .. w4, f) of the n-grams that occur `least` times; absent words are 0."""
    shared = texts.sparkSession.sparkContext.broadcast(table) if table is not None else None
    own = {s: Packing(s, bits) for s in sizes}
    lead = {s: min(shard_bits, own[s].half) for s in sizes}

    def shards(held: list[tuple], s: int) -> Iterator[pa.RecordBatch]:
        left, right, counts = held
        shard = (left >> U(own[s].half - lead[s])).astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        ends = np.append(heads[1:], len(shard))
        blobs = [to_filter(left[a:b], right[a:b], counts[a:b], own[s], lead[s]) for a, b in zip(heads.tolist(), ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blobs), s, np.int32)), pa.array(shard[heads]), c.binary(blobs)], ["size", "shard", "filter"])

    def merged(parts: list[tuple], s: int) -> tuple:
        return counted(*(np.concatenate([p[i] for p in parts]) for i in range(3)), own[s])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {s: [] for s in sizes}
        grown = dict.fromkeys(sizes, 0)
        for batch in batches:
            for blob, width in zip(batch.column("codes"), batch.column("width").to_pylist(), strict=True):
                codes = np.frombuffer(blob.as_buffer(), f"<u{width}")
                # Slices overlap by a phrase's words less one, so that each n-gram begins in one of them.
                for i in range(0, len(codes), HELD // 2):
                    for s in sizes:
                        words = _grams(codes[i:i + HELD // 2 + s - 1], s, shared.value if shared else None)
                        left, right = own[s].keys(words)
                        held[s].append(counted(left, right, np.ones(len(left), np.int64), own[s]))
                        grown[s] += len(held[s][-1][0])
                        if grown[s] > HELD:
                            held[s] = [merged(held[s], s)]
                            grown[s] = len(held[s][0][0])
                            if grown[s] > HELD // 2:
                                yield from shards(held[s][0], s)
                                held[s], grown[s] = [], 0
        for s in sizes:
            if grown[s]:
                yield from shards(merged(held[s], s), s)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Filters arrive by shard; one shard is held at a time."""
        at, parts, size, merged_size = None, [], 0, 0

        def done() -> Iterator[pa.RecordBatch]:
            left, right, counts = merged(parts, at[0])
            often = counts >= least
            if often.any():
                words = own[at[0]].words(left[often], right[often])
                zero = np.zeros(int(often.sum()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(w) for w in (words + [zero] * MOST_WORDS)[:MOST_WORDS]] + [pa.array(counts[often])],
                                                 ["w1", "w2", "w3", "w4", "f"])

        for batch in batches:
            for s, shard, blob in zip(batch.column("size").to_pylist(), batch.column("shard").to_pylist(), batch.column("filter"), strict=True):
                if at is not None and at != (s, shard):
                    yield from done()
                    parts, size, merged_size = [], 0, 0
                at = (s, shard)
                parts.append(from_filter(blob.as_py(), own[s], lead[s], shard))
                size += len(parts[-1][0])
                if size > max(HELD, 2 * merged_size):
                    parts = [merged(parts, s)]
                    size = merged_size = len(parts[0][0])
        if at is not None:
            yield from done()

    filters = texts.mapInArrow(count, "size int, shard long, filter binary")
    return filters.repartition("size", "shard").sortWithinPartitions("size", "shard").mapInArrow(merge, "w1 long, w2 long, w3 long, w4 long, f long")


# --- scores ---

WORDS = ["w1", "w2", "w3", "w4"]


def _part(first: int, n: int, prefix: str) -> list:
    """Words first .. first + n - 1 of a phrase as the key of a shorter phrase."""
    return [(F.col(WORDS[first + i]) if i < n else F.lit(0).cast("long")).alias(f"{prefix}{i + 1}") for i in range(MOST_WORDS)]


def scored(phrases: DataFrame) -> DataFrame:
    """Phrases of two words or more with their lowest-scoring cut: a, l, r, cut, score."""
    parts = {x: [f"{x}{i + 1}" for i in range(MOST_WORDS)] for x in "lr"}
    long_ = phrases.where("w2 > 0").withColumn("words", F.expr("if(w4 > 0, 4, if(w3 > 0, 3, 2))"))
    cuts = None
    for n in range(2, MOST_WORDS + 1):
        for k in range(1, n):
            rows = long_.where(F.col("words") == n).select(*WORDS, F.col("f").alias("a"), F.lit(k).alias("cut"), *_part(0, k, "l"), *_part(k, n - k, "r"))
            cuts = rows if cuts is None else cuts.unionByName(rows)
    for x in "lr":
        cuts = cuts.join(phrases.select(*[F.col(w).alias(p) for w, p in zip(WORDS, parts[x], strict=True)], F.col("f").alias(x)), parts[x])
    # Whole numbers of 38 digits: the product passes 64 bits at large counts.
    score = F.expr("cast(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div cast(cast(l as decimal(19,0)) + cast(r as decimal(19,0)) as decimal(20,0)) as long)")
    best = cuts.withColumn("score", score).groupBy(*WORDS, "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    return best.select(*WORDS, "a", "m.score", "m.cut", "m.l", "m.r")


def inside_longer(phrases: DataFrame) -> DataFrame:
    """Shorter phrases of two words or more that stand in a longer frequent one, with the largest count of such: (w1 .. w4, longer)."""
    out = None
    for n in range(3, MOST_WORDS + 1):
        whole = phrases.where(F.col(WORDS[n - 1]) > 0)
        if n < MOST_WORDS:
            whole = whole.where(F.col(WORDS[n]) == 0)
        for m in range(2, n):
            for first in range(n - m + 1):
                rows = whole.select(*[x.alias(w) for x, w in zip(_part(first, m, "w"), WORDS, strict=True)], F.col("f").alias("longer"))
                out = rows if out is None else out.unionByName(rows)
    return out.groupBy(*WORDS).agg(F.max("longer").alias("longer"))


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, and the words before the cut."""
    spark = docs.sparkSession
    runs = c.settle(runs_of(c.as_documents(docs, ("lang", "text"))), "runs")
    sizes = c.settle(runs.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    vocabulary = numbered(runs, least)
    known = vocabulary.agg(F.max("id").alias("ids"), F.sum("f").alias("words")).first()
    shape = "lang string, rank long, phrase string, a long, l long, r long, n long, score long, cut int"
    if known["ids"] is None:
        return spark.createDataFrame([], shape)
    bits = int(known["ids"]).bit_length()
    if bits > 30:
        raise ValueError("more than 2^30 frequent words")
    shard_bits = max(0, (int(known["words"]) // SHARD).bit_length())
    texts = c.settle(coded(runs, vocabulary), "coded")
    pairs = c.settle(grams(texts, (2,), bits, shard_bits, least), "pairs")
    n_pairs = pairs.count()
    longer = grams(texts, (3, 4), bits, shard_bits, least, bit_table(pairs, n_pairs))
    zero = F.lit(0).cast("long")
    single = vocabulary.select(F.col("id").alias("w1"), zero.alias("w2"), zero.alias("w3"), zero.alias("w4"), "f")
    phrases = c.settle(single.unionByName(pairs).unionByName(longer), "phrases")
    found = scored(phrases).join(inside_longer(phrases), WORDS, "left")
    found = found.where("longer is null or cast(longer as decimal(38,0)) * 100 < cast(a as decimal(38,0)) * " + str(share))
    for w in WORDS:
        names = vocabulary.select(F.col("id").alias(w), F.col("word").cast("string").alias(f"{w}_word"), *([F.col("lang")] if w == "w1" else []))
        found = found.join(names, w, "inner" if w in ("w1", "w2") else "left")
    found = found.withColumn("phrase", F.concat_ws(" ", *[f"{w}_word" for w in WORDS]))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut")
