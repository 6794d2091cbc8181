"""Quality scores from a linear model over n-gram indicators scaled by naive Bayes log-count ratios.

Indicators are n-grams of words (one and two, A-Z lowered), of words' shapes (up to three: case, length, first and last character,
repetition of the word or the two before) and of lines seen before, hashed to 2^BITS buckets. The class counts behind the
log-count ratios come from every labelled training text. The hinge-loss model is fitted by dual coordinate descent on a
bounded sample: the SAMPLE training texts of each class with the smallest hashes. Margins of texts that a half of the sample was
not fitted on give the logistic curve from margin to score, weighted back to the classes' shares.

Null and empty texts have no indicators; their score comes from the intercept. Labels that are null or differ for one id are
not learned from, nor are training texts without an id. With only one class, or none, all scores are that of the
smoothed share of label 1. Repeated rows count once each. An empty table gives no rows. Any further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

BITS, SAMPLE, CUT, FOLDS = 20, 8000, 0.3, 5
#: Dual coordinate descent: bound of a dual variable, passes, and the gap of projected gradients at which it ends.
BOUND, PASSES, GAP = 1.0, 40, 0.01
BLOCKS = 16
U = np.uint64
#: Classes of the bytes that begin or end a word.
CLASS = np.full(256, 7, np.uint8)
CLASS[65:91], CLASS[97:123], CLASS[48:58], CLASS[128:] = 1, 2, 3, 4
CLASS[list(b".,;:!?")] = range(8, 14)
CLASS[list(b"#*$%&|<>@_-/\\=+~^")] = range(14, 31)


def held_out(doc_id: str = "doc_id", folds: int = FOLDS) -> Column:
    """Whether the CRC-32 of the id as text leaves no rest: such rows are never learned from. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def _combined(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), U)
    for p in parts:
        out = c.mixed(out * U(0xA0761D6478BD642F) + p.astype(U) + U(1))
    return out


def _kinds(tag: int, values: np.ndarray, size: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of `size` inside the texts, and where they begin."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    at = np.flatnonzero(text[:n] == text[size - 1:])
    return _combined(np.full(len(at), tag), *(values[at + k] for k in range(size))), text[at]


def indicators(body: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, one after the other, and where each text's begin."""
    starts, ends, before = c.spans_of_words(body, at)
    size = len(at) - 1
    if len(starts):
        words = c.word_hash(c.lowered(body), at)[0]
        exact = c.word_hash(body, at)[0]
        upper, lower = (np.concatenate([[0], np.cumsum(x)]) for x in ((body >= 65) & (body <= 90), (body >= 97) & (body <= 122)))
        ups, lows, long_ = upper[ends] - upper[starts], lower[ends] - lower[starts], ends - starts
        case = np.where(lows == 0, np.where(ups > 0, 3, 0), np.where(ups == 0, 1, 2))
        text = np.repeat(np.arange(size), np.diff(before))
        again = np.zeros(len(starts), np.int64)
        for back in (1, 2):
            same = (exact[back:] == exact[:-back]) & (text[back:] == text[:-back])
            again[back:][same] += back
        # Length in steps that double; the last two characters, as junk is often appended to words.
        shape = _combined(case, np.log2(long_).astype(np.int64), CLASS[body[starts]], CLASS[body[ends - 1]], CLASS[body[np.maximum(ends - 2, starts)]], again)
        ending = _combined(CLASS[body[ends - 1]], CLASS[body[np.maximum(ends - 2, starts)]], case)
        grams = [_kinds(1, words, 1, before), _kinds(2, words, 2, before)]
        grams += [_kinds(2 + k, shape, k, before) for k in (1, 2)] + [_kinds(5 + k, ending, k, before) for k in (2, 3)]
        grams += [_kinds(9, again, 3, before)]
        # Windows of three words that the text has had before.
        full = c.window_hash(words, 3)
        inside = np.flatnonzero(text[:len(full)] == text[2:]) if len(full) else np.zeros(0, np.int64)
        order = inside[np.lexsort((inside, full[inside], text[inside]))]
        twice = order[1:][(full[order[1:]] == full[order[:-1]]) & (text[order[1:]] == text[order[:-1]])]
        counts = np.bincount(text[twice], minlength=size)
        shares = np.where(counts > 0, 1 + 20 * counts // np.maximum(np.diff(before), 1), 0)
        some = np.flatnonzero(np.diff(before) > 0)
        grams.append((_combined(np.full(len(some), 10), shares[some]), some))
        total = np.flatnonzero(np.diff(before) > 0)
        grams.append((_combined(np.full(len(total), 11), np.log2(np.diff(before)[total]).astype(np.int64)), total))
        hashes, owner = (np.concatenate(x) for x in zip(*grams, strict=True))
        both = np.unique((owner.astype(U) << U(bits)) | (hashes >> U(64 - bits)))
        return (both & U((1 << bits) - 1)).astype(np.int64), np.searchsorted(both >> U(bits), np.arange(size + 1).astype(U), "left")
    return np.zeros(0, np.int64), np.zeros(size + 1, np.int64)


def training(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS) -> DataFrame:
    """(key, text, label) of the labelled rows that may be learned from; `key` orders them by hash."""
    one = c.as_documents(labels, ("doc_id", label)).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    one = one.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other").drop("other")
    one = c.settle(one.where(~held_out(folds=folds)), "labels")
    # Texts without a label stay where they are: a bit table of bounded size leaves out nearly all of them before the join.
    table = docs.sparkSession.sparkContext.broadcast(c.bit_table(one.select(F.col("doc_id").cast("long")), "doc_id", one.count()))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(c.listed(table.value, batch.column("doc_id").to_numpy()), pa.bool_()))

    rows = c.as_documents(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & ~held_out(folds=folds))
    rows = rows.mapInArrow(labelled, "doc_id long, text string").join(one, "doc_id")
    return c.settle(rows.select(F.xxhash64("doc_id", "text").alias("key"), "text", (F.col("label") > 0).cast("int").alias("label")), "training")


def class_counts(rows: DataFrame, bits: int = BITS) -> np.ndarray:
    """Texts of class 0 and 1 that have each bucket (last column: all texts). Tasks count in arrays of fixed size and hand on
    compressed blocks, which Spark brings together."""
    size = (1 << bits) // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts = np.zeros((2, 1 << bits), np.int64), np.zeros(2, np.int64)
        for batch, body, at in c.pieces_of(batches):
            buckets, begin = indicators(body, at, bits)
            label = batch.column("label").to_numpy()
            own = np.repeat(label, np.diff(begin))
            for k in (0, 1):
                seen[k] += np.bincount(buckets[own == k], minlength=1 << bits)
            texts += np.bincount(label, minlength=2)
        if texts.any():
            parts = [zlib.compress(np.ascontiguousarray(seen[:, i * size:(i + 1) * size]).tobytes(), 1) for i in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS + 1), pa.int32()), c.binary([*parts, zlib.compress(texts.tobytes())])], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(zlib.decompress(part), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), c.binary(zlib.compress(v.tobytes(), 1) for v in sums.values())], ["block", "counts"])

    kind = "block int, counts binary"
    found = rows.select("text", "label").mapInArrow(count, kind).repartition(BLOCKS + 1, "block").mapInArrow(add, kind).collect()
    out = np.zeros((2, (1 << bits) + 1), np.int64)
    for r in found:
        part = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64)
        if r["block"] < BLOCKS:
            out[:, r["block"] * size:(r["block"] + 1) * size] = part.reshape(2, -1)
        else:
            out[:, -1] = part
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Log of a bucket's smoothed share among class 1 over that among class 0, zero where no text has it; the last one is the
    intercept's."""
    n = counts[:, -1:]
    out = np.log((counts[1, :-1] + 1) / (n[1] + 2)) - np.log((counts[0, :-1] + 1) / (n[0] + 2))
    return np.append(np.where(counts[:, :-1].sum(axis=0) > 0, out, 0.0), 1.0)


def descended(rows: list[np.ndarray], scaled: list[np.ndarray], sign: np.ndarray, size: int, bound: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights of the hinge-loss model by dual coordinate descent: each step solves one text's dual variable exactly."""
    weights, dual = np.zeros(size), np.zeros(len(rows))
    square = np.array([float(x @ x) for x in scaled])
    order = np.random.default_rng(seed)
    for _ in range(PASSES):
        widest = 0.0
        for i in order.permutation(len(rows)).tolist():
            if square[i] == 0:
                continue
            slope = sign[i] * float(weights[rows[i]] @ scaled[i]) - 1
            if (dual[i] == 0 and slope >= 0) or (dual[i] == bound[i] and slope <= 0):
                continue
            widest = max(widest, abs(slope))
            new = min(max(dual[i] - slope / square[i], 0.0), bound[i])
            weights[rows[i]] += (new - dual[i]) * sign[i] * scaled[i]
            dual[i] = new
        if widest < GAP:
            break
    return weights


def curve_of(margins: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic curve (slope, offset) from margins to shares of label 1, by Newton steps."""
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    # Shrunk targets keep the curve finite where the classes part entirely.
    up, down = label.sum(), (1 - label).sum()
    target = np.where(label > 0, (up + 1) / (up + 2), 1 / (down + 2))
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -35, 35)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (target - p)) - 1e-6 * at)
        at = at + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(at[0]), 0.0), float(at[1])


def fitted(rows: DataFrame, counts: np.ndarray, sample: int = SAMPLE, bits: int = BITS) -> tuple[np.ndarray, float, float]:
    """Weights (scaled by the ratios, the intercept last) and the curve, fitted in one task on `sample` texts of each class."""
    ratios = log_ratios(counts)
    shared = rows.sparkSession.sparkContext.broadcast(ratios)
    shares = counts[:, -1].astype(float)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in c.pieces_of(batches):
            buckets, begin = indicators(body, at, bits)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), c.binary(
                buckets[a:b].astype("<i4").tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True))], ["key", "label", "buckets"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        read = sorted((k, y, bytes(b)) for batch in batches for k, y, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        if not read:
            return
        texts = [np.append(np.frombuffer(b, "<i4"), 1 << bits) for _, _, b in read]
        label = np.array([y for _, y, _ in read])
        scaled = [_unit(r[x]) for x in texts]
        sign, size = np.where(label > 0, 1.0, -1.0), len(r)
        taken = np.bincount(label, minlength=2)
        bound = (BOUND * len(label) / (2 * np.maximum(taken, 1)))[label]
        half, margins = np.arange(len(label)) % 2, np.zeros(len(label))
        for k in (0, 1):
            own = np.flatnonzero(half == k)
            if len(own) < len(label):
                w = descended([texts[i] for i in own], [scaled[i] for i in own], sign[own], size, bound[own])
                for i in np.flatnonzero(half != k):
                    margins[i] = w[texts[i]] @ scaled[i]
        weights = descended(texts, scaled, sign, size, bound)
        slope, offset = curve_of(margins, label, (shares / shares.sum() / (np.maximum(taken, 1) / len(label)))[label])
        yield pa.RecordBatch.from_arrays([c.binary([zlib.compress((weights * r).astype("<f8").tobytes(), 1)]), pa.array([slope]), pa.array([offset])],
                                         ["weights", "slope", "offset"])

    # Some more rows than wanted by a bound on their hash, then the smallest ones: no sort of the whole table.
    picked = None
    for k in (0, 1):
        edge = min(int((1.5 * sample + 100) / max(shares[k], 1) * (1 << 64)), (1 << 64) - 1) - (1 << 63)
        own = rows.where((F.col("label") == k) & (F.col("key") <= F.lit(edge))).select("key", "text", "label").mapInArrow(code, "key long, label int, buckets binary")
        own = own.orderBy("key", "buckets").limit(sample)
        picked = own if picked is None else picked.unionByName(own)
    model = c.settle(picked, "sample").coalesce(1).mapInArrow(fit, "weights binary, slope double, offset double").collect()[0]
    return np.frombuffer(zlib.decompress(bytes(model["weights"])), "<f8"), model["slope"], model["offset"]


def _unit(x: np.ndarray) -> np.ndarray:
    """To length one, so that long texts do not outweigh short ones."""
    return x / np.sqrt(max(float(x @ x), 1e-12))


def scores(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = CUT, sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = training(docs, labels, label)
    counts = class_counts(rows, bits)
    known = counts[:, -1]
    model = None
    if known.min() > 0:
        weights, slope, offset = fitted(rows, counts, sample, bits)
        model = docs.sparkSession.sparkContext.broadcast((weights, log_ratios(counts)))
    constant = (int(known[1]) + 1) / (int(known.sum()) + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in c.pieces_of(batches):
            out = np.full(batch.num_rows, constant)
            if model is not None:
                weights, ratios = model.value
                buckets, begin = indicators(body, at, bits)
                sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in (weights[buckets], ratios[buckets] ** 2)]
                margin, length = (s[begin[1:]] - s[begin[:-1]] for s in sums)
                margin = (margin + weights[-1]) / np.sqrt(length + 1.0)
                out = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held"), pa.array(out), pa.array((out >= cut).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    return c.as_documents(docs).select("doc_id", "text", held_out().alias("held")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")
