"""Removal of repeated passages with run-compressed suffix indexes.

A byte is removed if a string of `length` bytes that covers it starts at another place too, in any document. To bring
equal strings together, each window of `length` bytes names its anchor: the leftmost of its k-grams with the smallest
hash. Equal windows have their anchor at the same place, so they meet in the anchor's group. Consecutive windows with one
anchor form a piece; pieces are compared by hash first. A piece found twice is repeated as a whole. Where pieces
of an anchor differ, one copy of each is fetched and indexed: the Burrows-Wheeler transform of the pieces is kept as
runs, with suffix-array samples at the runs' ends; the common prefixes at those samples give, streamed along the text,
the longest match of every position elsewhere.

Indexes take whole groups, a few hundred kilobytes together. A group of more than `most` differing pieces would
be too much for one task: its windows are counted by 128-bit hash instead, which Spark spreads like any other count.

Null texts are empty, and documents shorter than `length` are kept whole. Repeated rows repeat each other. An empty table
gives no rows. Any further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

LENGTH, GRAM, MOST = 400, 32, 4096
INDEX_BYTES = 512 << 10
_PLACE = np.uint64(31)


def row_key():
    """128 bits that identify a row; equal rows share them, and their spans."""
    return F.substring(F.unhex(F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                                                  F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).cast("binary"), 256)), 1, 16)


def anchors(body: np.ndarray, at: np.ndarray, length: int, gram: int):
    """Start of each piece, its number of windows, its anchor's place, and the anchor's hash."""
    m, w = len(body) - gram + 1, length - gram + 1
    if len(body) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    grams = c.gram_hash(body, gram)
    value = (grams >> _PLACE << _PLACE) | np.arange(m, dtype=np.uint64)
    blocks = -(-m // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = value
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(body) - length + 1
    least = np.minimum(behind[:n], ahead[w - 1:w - 1 + n])
    chosen = (least & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= length:
            inside[a] += 1
            inside[b - length + 1] -= 1
    inside = np.cumsum(inside[:n]) > 0
    new = inside.copy()
    new[1:] &= (chosen[1:] != chosen[:-1]) | ~inside[:-1]
    begin = np.flatnonzero(new)
    stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True)) + 1
    return begin, stop - begin, chosen[begin], grams[chosen[begin]].view(np.int64)


def _name(piece: bytes, place: int) -> int:
    """64 bits of BLAKE2b over a piece and its anchor's place; with the anchor they are its identity."""
    return int.from_bytes(hashlib.blake2b(place.to_bytes(8, "little") + piece, digest_size=8).digest(), "little", signed=True)


def pieces(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row per piece: anchor and content hashes, the document's key, start and number of windows (packed)."""
    rows = c.as_documents(docs).select(row_key().alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in c.pieces_of(batches):
            begin, windows, anchor, own = anchors(body, at, length, gram)
            owner = np.searchsorted(at, begin, "right") - 1
            start = begin - at[owner]
            # What the bytes leave open, where the anchor stands and how many windows there are, is in front of them.
            ends = begin + windows + length - 1
            data = body.tobytes()
            content = np.fromiter((_name(data[a:b], x) for a, b, x in zip(begin.tolist(), ends.tolist(), (((anchor - begin) << 16) | windows).tolist(), strict=True)),
                                  np.int64, len(begin))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array(content), batch.column("key").take(pa.array(owner)),
                 pa.array((start << 16) | windows)], ["anchor", "content", "key", "place"])

    return rows.mapInArrow(run, "anchor long, content long, key binary, place long")


def _sorted_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pairs and the pairs in that order, as single numbers. Where pair and place fit into 64 bits, plain
    values are sorted, which is several times faster than sorting places."""
    n = len(first)
    bits = (n + 1).bit_length()
    if 3 * bits > 64:
        joint = first * (n + 2) + second
        order = np.argsort(joint)
        return order, joint[order]
    width = np.uint64(bits)
    joint = np.sort((((first.astype(np.uint64) << width) | second.astype(np.uint64)) << width) | np.arange(n, dtype=np.uint64))
    return (joint & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64), joint >> width


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of several texts, with samples at the ends of its runs."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts])
        n = int(sizes.sum())
        symbols = np.zeros(n, np.int64)
        ends = np.cumsum(sizes) - 1
        inside = np.ones(n, bool)
        inside[ends] = False
        symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + len(texts)
        symbols[ends] = np.arange(len(texts))
        # Each text ends in a symbol of its own, so no match reaches across texts and all suffixes differ.
        rank = np.unique(symbols, return_inverse=True)[1]
        self.n, self.ranks = n, [rank.astype(np.int32)]
        step = 1
        while True:
            after = np.zeros(n, np.int64)
            after[:n - step] = rank[step:] + 1
            order, sorted_ = _sorted_pairs(rank, after)
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
            step *= 2
            if rank[order[-1]] == n - 1:
                break
            self.ranks.append(rank.astype(np.int32))
        before = symbols[order - 1]
        heads = np.concatenate([[0], np.flatnonzero(before[1:] != before[:-1]) + 1])
        tails = np.append(heads[1:], n) - 1
        self.heads, self.runs = heads, before[heads]
        #: Suffix-array samples at both ends of each run, with the suffixes beside them.
        self.first, self.above = order[heads], order[np.maximum(heads - 1, 0)]
        self.last, self.below = order[tails], order[np.minimum(tails + 1, n - 1)]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at x and y."""
        out = np.zeros(len(x), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            a, b = x + out, y + out
            ok = (a < self.n) & (b < self.n)
            same = np.zeros(len(x), bool)
            same[ok] = self.ranks[level][a[ok]] == self.ranks[level][b[ok]]
            out += same * (1 << level)
        return np.where(x == y, 0, out)

    def matches(self) -> np.ndarray:
        """Longest match elsewhere for every position: within a run it shrinks by one from each position to the next,
        so the values at the samples are all that is computed."""
        best = np.zeros(self.n, np.int64)
        for samples, beside in ((self.first, self.above), (self.last, self.below)):
            at = np.argsort(samples)
            where, value = samples[at], self.common(samples, beside)[at]
            own = np.searchsorted(where, np.arange(self.n), "right") - 1
            found = value[np.maximum(own, 0)] - (np.arange(self.n) - where[np.maximum(own, 0)])
            best = np.maximum(best, np.where(own >= 0, found, 0))
        return best


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """Starts, in each text, of the windows that occur elsewhere among the texts."""
    index = RunIndex(texts)
    long = index.matches() >= length
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return [np.flatnonzero(long[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def runs_of(starts: np.ndarray) -> list[int]:
    """Runs of consecutive numbers as packed (start, count)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    first, count = starts[np.concatenate([[0], cut])], np.diff(np.concatenate([[0], cut, [len(starts)]]))
    return ((first.astype(np.int64) << 16) | count).tolist()


def _fetched(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Text of one copy of each wanted piece."""
    lists = wanted.select("rep.key", F.struct("anchor", "content", "n", F.col("rep.place").alias("place")).alias("piece")).groupBy(
        "key").agg(F.collect_list("piece").alias("pieces"))
    texts = c.as_documents(docs).select(row_key().alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in c.pieces_of(batches):
            column = batch.column("pieces")
            counts = np.diff(column.offsets.to_numpy())
            flat = column.flatten()
            anchor, content, n, place = flat.flatten()
            begin = np.repeat(at[:-1], counts) + (place.to_numpy() >> 16)
            end = begin + (place.to_numpy() & 0xFFFF) + length - 1
            data = body.tobytes()
            yield pa.RecordBatch.from_arrays(
                [anchor, content, n, c.binary(data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True))],
                ["anchor", "content", "n", "piece"])

    # Equal rows share a key: either one serves.
    return texts.join(lists, "key").mapInArrow(run, "anchor long, content long, n long, piece binary").where("piece is not null")


def _indexed(fetched: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows of each piece, from an index over whole anchor groups."""
    dealt = fetched.repartition("anchor").sortWithinPartitions("anchor", "content")

    def done(held: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        held = list({(h[0], h[1]): h for h in held}.values())
        found = repeated_windows([h[3] for h in held], length)
        out = [(h[0], h[1], runs_of(f)) for h, f in zip(held, found, strict=True) if h[2] == 1 and len(f)]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["anchor", "content", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if size > INDEX_BYTES and row[0] != held[-1][0]:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield done(held)

    return dealt.mapInArrow(run, "anchor long, content long, runs array<long>")


def _counted(fetched: DataFrame, length: int) -> DataFrame:
    """The same for groups too large for one index: windows are counted by 128 bits of BLAKE2b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in c.pieces_of(batches, "piece", c.RUN_BYTES // 4):
            counts = np.maximum(np.diff(at) - length + 1, 0)
            row = np.repeat(np.arange(len(counts)), counts)
            first = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            begin = at[:-1][row] + first
            data = body.tobytes()
            digests = b"".join(hashlib.blake2b(data[b:b + length], digest_size=16).digest() for b in begin.tolist())
            one, two = np.frombuffer(digests, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays(
                [pa.array(one), pa.array(two),
                 *(batch.column(n).take(pa.array(row)) for n in ("anchor", "content", "n")), pa.array(first)],
                ["one", "two", "anchor", "content", "n", "first"])

    rows = fetched.mapInArrow(run, "one long, two long, anchor long, content long, n long, first long")
    # Equal windows count by content, which tells the pieces of an anchor apart.
    again = rows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    hits = rows.where("n = 1").join(again, ["one", "two"], "left_semi")
    return hits.groupBy("anchor", "content").agg(F.collect_list(F.expr("shiftleft(first, 16) + 1")).alias("runs"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """Per row key, the spans (start, bytes; packed) covered by repeated strings; spans may overlap."""
    if not gram <= length < 1 << 15:
        raise ValueError("length: at least one k-gram, less than 32768 bytes")
    rows = c.settle(pieces(docs, length, gram), "pieces")
    kinds = rows.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("rep"))
    groups = kinds.groupBy("anchor").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).where("total > 1")
    known = c.settle(kinds.join(groups, "anchor"), "kinds")
    whole = known.where("n > 1").select("anchor", "content", F.array(F.expr("rep.place & 65535")).alias("runs"))
    # Groups in which every piece is repeated as a whole need no index.
    differing = known.where("kinds > 1").join(
        known.where("n = 1").select(F.col("anchor").alias("a")).distinct(), F.col("anchor") == F.col("a"), "left_semi")
    large = known.where(F.col("kinds") > most).select("anchor").distinct()
    fetched = _fetched(docs, differing, length)
    if large.limit(1).count():
        fetched = c.settle(fetched, "fetched")
        found = _indexed(fetched.join(large, "anchor", "left_anti"), length).unionByName(
            _counted(fetched.join(large, "anchor", "left_semi"), length))
    else:
        found = _indexed(fetched, length)
    marks = whole.unionByName(found)
    hits = rows.join(marks, ["anchor", "content"])
    begin = F.shiftright(F.col("place"), 16)
    span = F.transform("runs", lambda r: F.shiftleft(begin + F.shiftright(r, 16), 20) + r.bitwiseAND(F.lit(0xFFFF)) + F.lit(length - 1))
    return hits.select("key", F.explode(span).alias("span")).groupBy("key").agg(F.collect_list("span").alias("spans"))


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """doc_id, the text without repeated passages (bytes), and what was removed."""
    spans = repeated_spans(docs, length, gram, most)
    texts = c.as_documents(docs).select(row_key().alias("key"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in c.pieces_of(batches):
            data, out = body.tobytes(), []
            for a, b, own in zip(at[:-1].tolist(), at[1:].tolist(), batch.column("spans").to_pylist(), strict=True):
                keep, end, removed, n = [], 0, 0, 0
                for span in sorted(own or ()):
                    begin, stop = span >> 20, (span >> 20) + (span & 0xFFFFF)
                    if begin > end or not n:
                        keep.append(data[a + end:a + begin])
                        n += 1
                        end = begin
                    removed += max(0, stop - end)
                    end = max(end, stop)
                keep.append(data[a + end:b])
                out.append((b - a, removed, n, b"".join(keep)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([o[i] for o in out], pa.int64()) for i in range(3)), c.binary(o[3] for o in out)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return texts.join(spans, "key", "left").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def removal_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    return deduplicated(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
