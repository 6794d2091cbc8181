"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed byte n-grams (letters in lower case, everything else in ASCII a space), with logarithmic
counts weighted by inverse document frequency and length one. Frequencies and final centroids come from all training
documents; only the first clustering, which decides where the centroids of a language start, sees a bounded sample of
`SAMPLE` documents per language, drawn by hash. A document takes the language of the centroid with the largest cosine.
`rejected` marks documents that are farther from it than all but one in `TAIL` of the training documents.

The model has a fixed number of dimensions and centroids per language, so it is bounded by the number of languages.
Null texts and texts without a letter are `und` with score 0; so is everything if there is no training document. Ties go
to the first language by code point. Null ids are held out. Repeated rows count once each. An empty table gives no rows.
Any further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

DIMENSIONS, SIZES, CENTROIDS, SAMPLE, TAIL, ROUNDS = 4096, (2, 3), 3, 400, 500, 8
BINS = 200
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def counts(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of n-gram counts per text."""
    rows = len(at) - 1
    out = np.zeros(rows * DIMENSIONS, np.float32)
    if len(body) < 2:
        return out.reshape(rows, DIMENSIONS)
    folded = _FOLD[body]
    owner = np.repeat(np.arange(rows, dtype=np.int64), np.diff(at))
    code = folded.copy()
    shift = np.uint64(64 - DIMENSIONS.bit_length() + 1)
    for n in range(2, max(SIZES) + 1):
        code = (code[:-1] << np.uint64(8)) | folded[n - 1:]
        if n in SIZES:
            inside = owner[:len(code)] == owner[n - 1:]
            place = ((code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64)
            out += np.bincount((owner[:len(code)] * DIMENSIONS + place)[inside], minlength=len(out)).astype(np.float32)
    return out.reshape(rows, DIMENSIONS)


def vectors(body: np.ndarray, at: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(body, at)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def has_letter(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    ascii_letter = ((body | 32) >= 97) & ((body | 32) <= 122)
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = total[at[1:]] > total[at[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(ch.isalpha() for ch in body[at[i]:at[i + 1]].tobytes().decode())
    return found


def training(docs: DataFrame) -> DataFrame:
    """Documents to learn from: those with a language that are not held out."""
    return docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Documents in which each dimension occurs: one array per task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for _, body, at in c.pieces_of(batches, rows=512):
            seen += (counts(body, at) > 0).sum(axis=0)
            n += len(at) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1)), pa.array(np.append(seen, n))], ["place", "n"])

    found = rows.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMENSIONS + 1, np.int64)
    for r in found:
        out[r["place"]] = r["n"]
    return out[:-1], int(out[-1])


def clustered(sample: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means; starts with the farthest points, in order, so it is the same each time."""
    picked = [0]
    while len(picked) < min(k, len(sample)):
        near = (sample @ sample[picked].T).max(axis=1)
        near[picked] = 2
        picked.append(int(near.argmin()))
    centres = sample[picked]
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.stack([sample[own == i].sum(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def sampled(rows: DataFrame) -> DataFrame:
    """SAMPLE rows per language at most. An id may have many rows, so the rows of the picked ids are numbered again."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id")
    ids = rows.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE)
    # SAMPLE ids per language at most: a bounded broadcast.
    picked = rows.join(F.broadcast(ids.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi")
    again = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id", F.xxhash64("text"), "text")
    return picked.withColumn("n", F.row_number().over(again)).where(F.col("n") <= SAMPLE).drop("n")


def first_centroids(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """Rows (lang, cluster, values) from the sample of each language; a group holds SAMPLE documents at most."""
    picked = sampled(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in c.pieces_of(batches, rows=512):
            v = vectors(body, at, idf).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc_id"), c.binary(x.tobytes() for x in v)], ["lang", "doc_id", "v"])

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "v"])
        centres = clustered(np.stack([np.frombuffer(x, np.float32) for x in frame["v"]]))
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "cluster": range(len(centres)), "v": [x.tobytes() for x in centres]})

    return picked.mapInArrow(run, "lang string, doc_id long, v binary").groupBy("lang").applyInPandas(
        group, "lang string, cluster int, v binary")


class Model:
    """Weights, centroids in order of language, and the cosine below which a centroid rejects."""

    def __init__(self, idf: np.ndarray, langs: list[str], centres: np.ndarray, least: np.ndarray):
        self.idf, self.langs, self.centres, self.least = idf, langs, centres, least

    def predict(self, body: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        letters = has_letter(body, at)
        if not self.langs:
            return ["und"] * (len(at) - 1), np.zeros(len(at) - 1), np.ones(len(at) - 1, bool)
        near = vectors(body, at, self.idf) @ self.centres.T
        best = near.argmax(axis=1)
        score = np.where(letters, np.clip(near[np.arange(len(best)), best], 0, 1), 0.0).astype(float)
        names = [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return names, score, ~letters | (score < self.least[best])


def fit(docs: DataFrame) -> Model:
    rows = training(docs)
    seen, n = document_frequencies(rows)
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
    start = sorted(((r["lang"], r["cluster"], np.frombuffer(bytes(r["v"]), np.float32)) for r in first_centroids(rows, idf).collect()),
                   key=lambda r: (r[0].encode(), r[1]))
    if not start:
        return Model(idf, [], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0))
    langs, centres = [r[0] for r in start], np.stack([r[2] for r in start])
    own = {lang: [i for i, x in enumerate(langs) if x == lang] for lang in langs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(langs), DIMENSIONS + BINS))
        for batch, body, at in c.pieces_of(batches, rows=512):
            v = vectors(body, at, idf)
            near = v @ centres.T
            for lang, group in _groups(batch.column("lang").to_pylist()).items():
                at_home = near[np.ix_(group, own[lang])]
                which = np.array(own[lang])[at_home.argmax(axis=1)]
                bins = np.minimum((at_home.max(axis=1).clip(0, 1) * BINS).astype(int), BINS - 1)
                for i in set(which.tolist()):
                    sums[i, :DIMENSIONS] += v[np.array(group)[which == i]].sum(axis=0)
                np.add.at(sums, (which, DIMENSIONS + bins), 1)
        # One row per task and centroid; fixed-point numbers, so that sums do not depend on their order.
        whole = np.round(sums * 1e6).astype(np.int64)
        filled = np.nonzero(whole)
        yield pa.RecordBatch.from_arrays([pa.array(filled[0]), pa.array(filled[1]), pa.array(whole[filled])], ["centre", "place", "total"])

    found = rows.select("text", "lang").mapInArrow(run, "centre long, place long, total long").groupBy("centre", "place").agg(
        F.sum("total").alias("total")).toPandas()
    sums = np.zeros((len(langs), DIMENSIONS + BINS))
    sums[found["centre"], found["place"]] = found["total"]
    final = sums[:, :DIMENSIONS]
    final = np.where(final.any(axis=1, keepdims=True), final, centres)
    final = (final / np.maximum(np.linalg.norm(final, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    upto = np.cumsum(sums[:, DIMENSIONS:], axis=1)
    least = (upto < upto[:, -1:] / TAIL).sum(axis=1) / BINS
    return Model(idf, langs, final, least)


def _groups(values: list[str]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, v in enumerate(values):
        out.setdefault(v, []).append(i)
    return out


def predictions(docs: DataFrame) -> DataFrame:
    model = fit(docs)
    # Bounded by dimensions x centroids x languages.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in c.pieces_of(batches, rows=512):
            names, score, rejected = shared.value.predict(body, at)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(score), pa.array(rejected)],
                                             ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
