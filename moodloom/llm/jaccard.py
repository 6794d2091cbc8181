"""N-gram Jaccard join with rare-first prefixes.

Texts are sets of word shingles. Equal sets are one class, so copies never meet in pairs. A fixed number of counters,
summed over all texts, tells frequent shingles from rare ones; each set is ordered by that level and then by hash, which is
one order for all sets, and only its prefix is listed: sets that reach the threshold share a shingle there. Candidates pass
a length filter, a positional filter and a suffix filter (histograms over the ordered hashes bound the overlap), and are
verified once per pair on whole sets.

Groups of near copies would make many pairs that say nothing new. So a first round links neighbours within some lists
only; the next ones compare every set with a few pivots of its list in other components; then come all other pairs in
different components, again one for any two components before the rest that is still apart. No link between different components is lost. Lists too long for one task are split into blocks that meet pairwise.

Null, empty and blank texts have the empty set, link with nothing and are components of their own. Equal ids are one
document to the result's smallest id, but every row is judged by its own text. An empty table gives no rows. Any further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c
from .graph import components
from .suffix import row_key

WORDS, PERCENT = 5, 80
COUNTERS, BLOCKS = 1 << 20, 64
#: Rows of a list that one task compares at once.
LIST = 20_000
#: Pairs that a task holds at once.
PAIRS = 200_000
#: One in so many lists takes part in the first round.
SOME = 4
#: Rounds of pivots, and pivots of a list and size in each.
ROUNDS, PIVOTS = 3, 4
#: Ranges of the histograms that lists carry for their last round, and earlier lists of a set that its rows carry.
RANGES, EARLIER = 64, 4


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def histogram(hashes: np.ndarray) -> bytes:
    """How many hashes of the set fall into each of 2^k ranges, of which there are half as many as hashes, or more.
    Counts stop at 255, which only weakens the bound."""
    k = max(3, int(len(hashes) // 2).bit_length())
    return np.bincount((hashes >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k).clip(max=255).astype(np.uint8).tobytes()


def difference(x: bytes, y: bytes) -> int:
    """Least number of hashes that two sets with these histograms do not share. Neighbouring ranges of the finer one are
    added up until both have the same ranges."""
    a, b = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
    if 255 in (a.max(), b.max()):
        return 0
    while len(a) > len(b):
        a = a.reshape(-1, 2).sum(axis=1)
    while len(b) > len(a):
        b = b.reshape(-1, 2).sum(axis=1)
    return int(np.abs(a - b).sum())


def coarse(spread: bytes, ranges: int = RANGES) -> bytes:
    """A histogram over so many ranges only, each one the sum of finer ones (or split in whole where there are fewer)."""
    a = np.frombuffer(spread, np.uint8).astype(np.int64)
    if 255 in a:
        return bytes(ranges)
    while len(a) > ranges:
        a = a.reshape(-1, 2).sum(axis=1)
    return np.append(a, np.zeros(ranges - len(a), np.int64)).clip(max=255).astype(np.uint8).tobytes() if len(a) == ranges else bytes(ranges)


def shrunk(text: bytes) -> bytes:
    """A text compressed, with its length in front: texts of sets travel and wait like this."""
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def grown(packed: bytes) -> bytes:
    size = int.from_bytes(packed[:8], "little")
    return pa.decompress(packed[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def classes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row: row key, doc_id, key of its shingle set (null if empty), size of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in c.pieces_of(batches):
            sets = c.shingles_of(body, at, words, fold_case=True)
            keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), keys, pa.array([len(s) for s in sets], pa.int64())],
                                             ["row", "doc_id", "key", "n"])

    return c.as_documents(docs).select(row_key().alias("row"), "doc_id", "text").mapInArrow(run, "row binary, doc_id long, key binary, n long")


def levels(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Frequency level of each counter: 0 for what chance gives, else the length of its count in bits.

    A task adds its texts' shingles to COUNTERS counters and hands on BLOCKS compressed parts; Spark adds them up. The
    result has a fixed size, one byte per counter.
    """
    size = COUNTERS // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.int64)
        for _, body, at in c.pieces_of(batches):
            own = c.shingles_of(body, at, words, fold_case=True)
            seen += np.bincount((np.concatenate(own) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        if seen.any():
            parts = [zlib.compress(seen[i * size:(i + 1) * size].tobytes(), 1) for i in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), c.binary(parts)], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(zlib.decompress(part), np.int64)
        parts = [zlib.compress(v.tobytes(), 1) for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), c.binary(parts)], ["block", "counts"])

    kind = "block int, counts binary"
    # Each block of counters is added up in one task, in place: its size does not depend on the input.
    found = docs.select("text").mapInArrow(count, kind).repartition(BLOCKS // 4, "block").mapInArrow(add, kind).collect()
    total = np.zeros(COUNTERS, np.int64)
    for r in found:
        total[r["block"] * size:(r["block"] + 1) * size] += np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64)
    usual = max(1.0, 4 * total.mean())
    return np.where(total <= usual, 0, np.ceil(np.log2(total + 1))).clip(0, 31).astype(np.uint8)


def ordered(hashes: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The set in the order of all sets: level first, then hash."""
    lead = level[(hashes % np.uint64(COUNTERS)).astype(np.int64)].astype(np.uint64)
    return np.sort((lead << np.uint64(58)) | (hashes >> np.uint64(6)))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Shared shingles that sets of these sizes need: 100 s >= percent (a + b - s)."""
    return -(-percent * (a + b) // (100 + percent))


def lists(docs: DataFrame, ids: str, level: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Prefix shingles with the sets that have them: (shingle, id, meta = size << 32 | position), of sets that have one of like size in the list."""
    shared = docs.sparkSession.sparkContext.broadcast(level)
    half = slice(0, 8) if ids == "first" else slice(8, 16)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for _, body, at in c.pieces_of(batches):
            shingles, names, meta = [], [], []
            for s in c.shingles_of(body, at, words, fold_case=True):
                key = set_key(s)[half]
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                p = prefix_length(len(s), percent)
                shingles.append(ordered(s, shared.value)[:p])
                names.append(np.full(p, int.from_bytes(key, "little", signed=True), np.int64))
                meta.append((np.int64(len(s)) << np.int64(32)) | np.arange(p, dtype=np.int64))
            if shingles:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingles).view(np.int64)), pa.array(np.concatenate(names)),
                                                  pa.array(np.concatenate(meta))], ["shingle", "id", "meta"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Length filter: a row stays if its list has a set of like size, and if so one beside it, as lists arrive sorted by
        size. The last row waits until the next one is known."""
        held, follows = np.zeros((3, 0), np.int64), False
        for batch in _with_end(batches):
            new = np.stack([x.to_numpy() for x in batch.columns]) if batch is not None else held[:, :0]
            rows = np.concatenate([held, new], axis=1)
            if not rows.shape[1]:
                continue
            keep = np.ones(rows.shape[1], bool)
            keep[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
            rows = rows[:, keep]
            size = rows[2] >> 32
            same = (rows[0, 1:] == rows[0, :-1]) & (100 * size[:-1] >= percent * size[1:])
            before = np.concatenate([[follows], same])
            several = before | np.append(same, False)
            if batch is not None:
                held, follows = rows[:, -1:], bool(before[-1])
                rows, several = rows[:, :-1], several[:-1]
            if several.any():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows[:, several]], ["shingle", "id", "meta"])

    rows = docs.select("text").mapInArrow(emit, "shingle long, id long, meta long")
    return rows.repartition("shingle").sortWithinPartitions("shingle", "meta", "id").mapInArrow(repeated, "shingle long, id long, meta long")


def _with_end(items, end=None):
    yield from items
    yield end


def neighbours(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """First round: in some lists, each set with the one before it in order of size."""
    some = rows.where(F.pmod(F.xxhash64("shingle"), F.lit(SOME)) == 0)
    before = Window.partitionBy("shingle").orderBy(F.shiftright("meta", 32), "id")
    pairs = some.select("id", "meta", F.lag("id").over(before).alias("other"), F.lag("meta").over(before).alias("other_meta"))
    pairs = pairs.where("other is not null").where(
        F.shiftright("other_meta", 32) * 100 >= F.shiftright("meta", 32) * percent)
    return pairs.select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()


def pivots(rows: DataFrame, found: DataFrame, turn: int, percent: int = PERCENT) -> DataFrame:
    """Pairs of each set with a few pivots of its list in other components: as many pairs as rows times PIVOTS at most. Pivots
    have the smallest hashes among sets of like size, so lists of the same sets agree on them."""
    step = F.floor(F.log(F.shiftright("meta", 32).cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    known = _known(rows, found).withColumn("step", step)
    lots = [F.min(F.struct(F.xxhash64("id", F.lit(turn * PIVOTS + k)).alias("lot"), "id", "component", "meta")) for k in range(PIVOTS)]
    chosen = known.groupBy("shingle", "step").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.array_distinct(F.array(*[
        lot.dropFields("lot") for lot in lots])).alias("pivots")).where("low <> high").select("shingle", "step", "pivots")
    pairs = known.join(chosen, ["shingle", "step"]).select("id", "component", "meta", F.explode("pivots").alias("p"))
    pairs = pairs.where("component <> p.component").withColumn("lead", F.expr(
        "shiftright(meta, 32) > shiftright(p.meta, 32) or (shiftright(meta, 32) = shiftright(p.meta, 32) and id > p.id)"))
    one, two = (F.struct(F.shiftright(m, 32).alias("n"), F.expr(f"{m} & 4294967295").alias("at"), F.col(i).alias("id")) for m, i in (("meta", "id"), ("p.meta", "p.id")))
    pairs = pairs.select(F.when(F.col("lead"), one).otherwise(two).alias("a"), F.when(F.col("lead"), two).otherwise(one).alias("b"))
    least = f"(({percent} * (a.n + b.n) + {99 + percent}) div {100 + percent})"
    return pairs.where(f"100 * b.n >= {percent} * a.n and least(a.n - a.at, b.n - b.at) >= {least} and b.at <= b.n - {least}").select("a.id", F.col("b.id").alias("b")).withColumnRenamed("id", "a").distinct()


def _known(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def still_mixed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of lists with several components. Components only grow together, so the other lists have nothing more to tell."""
    known = _known(rows, found)
    open_ = known.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle")
    return rows.join(open_, "shingle", "left_semi")


def crossing(rows: DataFrame, found: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All pairs of a list in different components that pass the length and positional filters, and the suffix filter on
    coarse histograms, which come with the rows and not with the pairs."""
    return meetings(rows, found, sets, percent).distinct()


def meetings(rows: DataFrame, found: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The same with few pairs repeated.

    Sets meet in every list they share. The filters never drop a linked pair in the first of these, so a row names the first
    few lists of its set before its own, and a pair that has one of them in common is left to that one."""
    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), c.binary(coarse(x) for x in batch.column("spread").to_pylist())], ["id", "spread"])

    before = Window.partitionBy("id").orderBy("shingle").rowsBetween(Window.unboundedPreceding, -1)
    earlier = {f"before_{k}": F.coalesce(F.nth_value("shingle", k + 1).over(before), F.lit(-1)) for k in range(EARLIER)}
    known = _known(rows.withColumns(earlier), found).join(sets.select("id", "spread").mapInArrow(shorten, "id long, spread binary"), "id")
    sizes = known.groupBy("shingle").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = sizes.where("low <> high").select("shingle", F.expr(f"cast((size + {LIST} - 1) div {LIST} as int)").alias("k"))
    block = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")
    rows = known.join(mixed, "shingle").withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("shingle", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "component", "id", "meta", "block", *earlier, "spread")

    def pairs(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """All pairs of different components within the groups (shingle, i, j) of these sorted rows."""
        shingle, i, j, component, name, meta, own, *earlier, spread = columns
        n = len(name)
        new = np.ones(n, bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        other = new.copy()
        other[1:] |= component[1:] != component[:-1]
        ends = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1]
        after = np.append(np.flatnonzero(other)[1:], n)[np.cumsum(other) - 1]
        counts = ends - after
        upto = np.cumsum(counts)
        begin = 0
        while begin < n:
            stop = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, "right")))
            own_counts = counts[begin:stop]
            x = np.repeat(np.arange(begin, stop), own_counts)
            y = np.arange(len(x)) - np.repeat(np.cumsum(own_counts) - own_counts, own_counts) + after[x]
            begin = stop
            ok = (i[x] == j[x]) | (own[x] != own[y])
            x, y = x[ok], y[ok]
            size = meta >> 32
            swap = (size[x] < size[y]) | ((size[x] == size[y]) & (name[x] < name[y]))
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            a, b, pa_, pb = size[x], size[y], meta[x] & 0xFFFFFFFF, meta[y] & 0xFFFFFFFF
            ok = (100 * b >= percent * a) & (1 + np.minimum(a - pa_ - 1, b - pb - 1) >= least_overlap(a, b, percent)) & (
                pb <= b - least_overlap(b, b, percent))
            x, y, need = x[ok], y[ok], 2 * least_overlap(a, b, percent)[ok]
            apart_ = np.abs(spread[x].astype(np.int16) - spread[y].astype(np.int16)).sum(axis=1)
            ok = (a[ok] + b[ok] - apart_ >= need) | (spread[x] == 255).any(axis=1) | (spread[y] == 255).any(axis=1) | ~spread[x].any(axis=1) | ~spread[y].any(axis=1)
            x, y = x[ok], y[ok]
            met = np.zeros(len(x), bool)
            for p in earlier:
                for q in earlier:
                    met |= (p[x] == q[y]) & (p[x] >= 0)
            x, y = x[~met], y[~met]
            if len(x):
                both = np.unique(np.stack([name[x], name[y]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of at most 2 x LIST rows; whole groups only are paired."""
        held: list[np.ndarray] | None = None
        for batch in _with_end(batches):
            if batch is not None:
                new = [x.to_numpy() for x in batch.columns[:-1]] + [c.raw(batch.column("spread"))[0].reshape(-1, RANGES)]
                held = new if held is None else [np.concatenate(p) for p in zip(held, new, strict=True)]
            if held is None or not len(held[0]):
                continue
            cut = len(held[0])
            if batch is not None:
                last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from pairs([h[:cut] for h in held])
                held = [h[cut:] for h in held]

    dealt = rows.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j", "component", "id")
    return dealt.mapInArrow(run, "a long, b long")


def fitting(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Suffix filter: the difference of two histograms bounds what the sets can share."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("spread").alias(f"s{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            apart = [difference(x, y) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)]
            most = (na + nb - np.array(apart, np.int64)) // 2
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(
                pa.array(most >= least_overlap(na, nb, percent)))

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Links among the pairs: whole sets are compared, each pair once."""
    for side in "ab":
        pairs = pairs.join(texts.select(F.col("id").alias(side), F.col("text").alias(f"text_{side}")), side)

    def linked_pairs(held: list[tuple]) -> pa.RecordBatch:
        sides = []
        for k in (2, 3):
            texts = [grown(h[k]) for h in held]
            sides.append(c.shingles_of(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), words, True))
        shared = [(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)) for x, y in zip(*sides, strict=True)]
        ok = [h for h, (s, n) in zip(held, shared, strict=True) if 100 * s >= percent * (n - s)]
        return pa.RecordBatch.from_arrays([pa.array([h[k] for h in ok], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = zip(*(batch.column(n).to_pylist() for n in ("a", "b", "text_a", "text_b")), strict=True)
            held, size = [], 0
            for a, b, x, y in _with_end(pair, (None,) * 4):
                # Both texts of a pair count: RUN_BYTES at most, or a single pair.
                more = sum(int.from_bytes(v[:8], "little") for v in (x, y)) if x else 0
                if held and (x is None or size + more > c.RUN_BYTES):
                    yield linked_pairs(held)
                    held, size = [], 0
                held.append((a, b, x, y))
                size += more

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def texts_of(docs: DataFrame, wanted: DataFrame, ids: str, words: int = WORDS) -> DataFrame:
    """Per wanted id one text (`shrunk`), the size of its set and its histogram, as a table bucketed by id: joins with it move pairs,
    never texts. A task hands on one copy of a set, and a bit table of bounded size leaves out most sets that nobody wants."""
    half = slice(0, 8) if ids == "first" else slice(8, 16)
    spark = docs.sparkSession
    names = c.settle(wanted.select("id").distinct(), "wanted")
    shared = spark.sparkContext.broadcast(c.bit_table(names, "id", names.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch, body, at in c.pieces_of(batches):
            sets = c.shingles_of(body, at, words, True)
            keys = np.array([int.from_bytes(set_key(s)[half], "little", signed=True) if len(s) else 0 for s in sets], np.int64)
            hit = c.listed(shared.value, keys)
            rows = [i for i, s in enumerate(sets) if len(s) and hit[i] and not (keys[i] in seen or seen.add(keys[i]))]
            if rows:
                data = body.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[rows]), c.binary(shrunk(data[at[i]:at[i + 1]]) for i in rows), pa.array([len(sets[i]) for i in rows], pa.int64()),
                     c.binary(histogram(sets[i]) for i in rows)], ["id", "text", "n", "spread"])

    rows = docs.select("text").mapInArrow(run, "id long, text binary, n long, spread binary")
    rows = rows.join(names, "id", "left_semi").dropDuplicates(["id"])
    name = f"texts_{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").option("path", c.scratch(spark, "texts")).bucketBy(
        max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "id").saveAsTable(name)
    return spark.table(name)


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs in different components, with these as low and high."""
    for side in "ab":
        pairs = pairs.join(found.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left")
    ends = [F.coalesce(f"c{s}", s) for s in "ab"]
    return pairs.select("a", "b", F.least(*ends).alias("low"), F.greatest(*ends).alias("high")).where("low <> high")


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: row key, doc_id, n (size of its set), `class` and `component` (null for empty sets)."""
    docs = c.as_documents(docs)
    rows = c.settle(classes(docs, words), "classes")
    # A class is named by half of its key; should two keys share that half, by the other one.
    half, ids = F.substring("key", 1, 8), "first"
    if rows.where("n > 0").groupBy(half.alias("half")).agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").limit(1).count():
        half, ids = F.substring("key", 9, 8), "second"
    rows = rows.withColumn("id", _number(half))
    shared = c.settle(lists(docs, ids, levels(docs, words), words, percent), "lists")
    texts = texts_of(docs, shared, ids, words)
    links, found, seen = None, None, None
    # Neighbours; a few rounds of pivots; then every pair that is still apart.
    for turn in range(ROUNDS + 2):
        last = turn == ROUNDS + 1
        if turn == 1:
            # Most lists that ever become one component are so after the neighbours; pivots pass over those that follow.
            shared = c.settle(still_mixed(shared, found), "mixed")
        pairs = neighbours(shared, percent) if not turn else crossing(shared, found, texts, percent) if last else pivots(shared, found, turn, percent)
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = c.settle(pairs, "candidates")
        seen = pairs if seen is None else seen.unionByName(pairs)
        pairs = c.settle(fitting(pairs, texts, percent), "pairs")
        if last:
            # Where one pair links two components, the others between them need no look.
            single = c.settle(apart(pairs, found).groupBy("low", "high").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b"), "pairs")
            links = links.unionByName(c.settle(verified(single, texts, words, percent), "links"))
            pairs = apart(pairs.join(single, ["a", "b"], "left_anti"), components(links)).select("a", "b")
        new = c.settle(verified(pairs, texts, words, percent), "links")
        links = new if links is None else links.unionByName(new)
        found = components(links)
    return rows.join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "row", "doc_id", "n", F.when(F.col("n") > 0, F.col("id")).alias("class"),
        F.when(F.col("n") > 0, F.coalesce("component", "id")).alias("component"))


def _number(eight):
    """Eight bytes as a long, little-endian."""
    parts = [F.shiftleft(F.conv(F.hex(F.substring(eight, i + 1, 1)), 16, 10).cast("long"), 8 * i) for i in range(8)]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach."""
    rows = linked(docs, words, percent)
    first = rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents with all their columns, one of each component: that of the smallest id (of the smallest row key, where
    ids repeat). Documents without words stay."""
    rows = linked(docs, words, percent).where("n > 0")
    kept = rows.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("best")).select(F.col("best.row").alias("__row"))
    keyed = docs.withColumn("__key", row_key()).join(kept, F.col("__key") == F.col("__row"), "left")
    nth = F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(1)))
    wordless = ~F.coalesce("text", F.lit("")).rlike(c.WORD)
    keyed = keyed.where(wordless | F.col("__row").isNotNull()).withColumn("__nth", nth)
    return keyed.where(wordless | (F.col("__nth") == 1)).select(docs.columns)
