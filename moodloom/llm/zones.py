"""Centroid clustering over zone maps: Hilbert-ordered blocks of vectors with their least and greatest components.

Vectors become integers floor(scale * x). A bounded sample gives axes of large variance; the place on them is read as one
number along a Hilbert curve, and tables are range-partitioned by it, so that neighbours share a block. A block keeps
its vectors and a zone map: least, greatest and summed components. Each round sends the centroids to the blocks. Distances
between box and centroids leave a block's candidates; a centroid also goes if another one is nearer everywhere in the
box. Where one candidate is left its sum of the block is taken as it stands, else all its vectors are compared with the candidates,
exactly. Axes, order and blocks decide what is compared, never the result.

A task hands on one sum per centroid, Spark adds these up, and rounds exchange centroids x components numbers. The range
partitioning breaks ties by place, so copies of one vector spread over tasks.

A vector counts if it has exactly `width` components, none null or infinite or NaN; others, and null vectors, give no row. A null id
is hashed as an empty one. Equal vectors, with equal ids or not, are vectors of their own; equal hashes are ordered by
components. With fewer vectors than centroids there are as many centroids as vectors, with none there are no rows. Components whose
integer reaches 2^27 raise an error, since squared distances would pass 64 bits. Any further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

CENTROIDS, ROUNDS, WIDTH, SCALE = 40, 5, 64, 256
#: Vectors that the axes are fitted on, axes, bits for each, and vectors of a block.
SAMPLE, AXES, BITS, BLOCK = 4096, 8, 7, 256
#: Below this, sums of products of 64 components are exact as doubles.
EXACT, MOST = 1 << 22, 1 << 27


def whole_vectors(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that count, as integers."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & (F.abs(e) < float("inf")) & ~F.isnan(e))
    rows = c.as_documents(vectors, ("vec_id", "embedding")).where(F.coalesce((F.size(x) == width) & finite, F.lit(False)))

    def number(e):
        product = e.cast("double") * F.lit(float(scale))
        return F.when(F.abs(product) < float(MOST), F.floor(product).cast("int")).otherwise(
            F.raise_error(F.lit("a component is too large for exact distances")).cast("int"))

    return rows.select("vec_id", F.transform(x, number).alias("v"))


def first_vectors(whole: DataFrame, n: int, seed: str = "2:") -> list[list[int]]:
    """The n vectors with the smallest hash of seed and id, in that order."""
    order = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [r["v"] for r in whole.select(order.alias("h"), "v").orderBy("h", "v").limit(n).select("v").collect()]


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of cells (rows x axes, `bits` bits each), by undoing the curve's turns bit by bit."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            turn = (x[i] & q) > 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turn, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip, q = np.zeros(len(cells), np.int64), 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) > 0, flip ^ (q - 1), flip)
        q >>= 1
    place = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for xi in x:
            place = (place << 1) | (((xi ^ flip) >> b) & 1)
    return place


class Curve:
    """Axes of large variance of a sample, each cut into equal cells between its extremes there."""

    def __init__(self, sample: np.ndarray, axes: int = AXES, bits: int = BITS):
        self.middle, self.bits = sample.mean(axis=0), bits
        spread = (sample - self.middle).T @ (sample - self.middle)
        self.axes = np.linalg.eigh(spread)[1][:, ::-1][:, :axes]
        places = (sample - self.middle) @ self.axes
        self.low = places.min(axis=0)
        self.step = np.maximum((places.max(axis=0) - self.low) / (1 << bits), 1e-9)

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        cells = np.floor(((vectors - self.middle) @ self.axes - self.low) / self.step)
        return hilbert(np.clip(cells, 0, (1 << self.bits) - 1).astype(np.int64), self.bits)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def blocks(whole: DataFrame, curve: Curve, width: int = WIDTH, size: int = BLOCK) -> DataFrame:
    """One row per block: ids, vectors and the zone map, in the order of the curve."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            # Copies share a place on the curve; a second number spreads them.
            own = c.mixed((np.arange(before, before + n) + (part << 40)).astype(np.uint64)).view(np.int64)
            before += n
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(curve(_matrix(batch.column("v"), width))), pa.array(own)],
                                             ["vec_id", "v", "place", "tie"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), width).astype("<i4")
            heads = np.arange(0, len(v), size)
            if not len(heads):
                continue
            at = np.append(heads, len(v)).astype(np.int32)
            zone = [np.minimum.reduceat(v, heads), np.maximum.reduceat(v, heads), np.add.reduceat(v.astype("<i8"), heads)]
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(at), batch.column("vec_id")), c.binary(v[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)),
                 *(c.binary(row.tobytes() for row in z) for z in zone)], ["ids", "vectors", "least", "most", "total"])

    rows = whole.mapInArrow(keyed, "vec_id long, v array<int>, place long, tie long")
    dealt = rows.repartitionByRange("place", "tie").sortWithinPartitions("place", "tie").select("vec_id", "v")
    return dealt.mapInArrow(cut, "ids array<long>, vectors binary, least binary, most binary, total binary")


def candidates(least: np.ndarray, most: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids may be nearest to a vector of each box (blocks x centroids). Ties stay unless a smaller number wins them."""
    low, high = least[:, None, :], most[:, None, :]
    near = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    far = np.maximum(np.abs(centroids - low), np.abs(high - centroids))
    at_least, at_most = (near * near).sum(axis=2), (far * far).sum(axis=2)
    open_ = at_least <= at_most.min(axis=1, keepdims=True)
    # The difference of two squared distances is linear in the vector: its least value lies in a corner of the box.
    pivot = at_most.argmin(axis=1)
    step = centroids[None, :, :] - centroids[pivot][:, None, :]
    squares = (centroids * centroids).sum(axis=1)
    gain = squares[None, :] - squares[pivot][:, None] - 2 * np.where(step > 0, step * high, step * low).sum(axis=2)
    number = np.arange(len(centroids))[None, :]
    return open_ & ((gain < 0) | ((gain == 0) & (number <= pivot[:, None])))


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smallest of equals) and the squared distance, exactly."""
    if max(np.abs(vectors).max(), np.abs(centroids).max()) < EXACT and vectors.shape[1] <= 64:
        x, y = vectors.astype(float), centroids.astype(float)
        square = (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]
    else:
        x, y = vectors.astype(np.int64), centroids.astype(np.int64)
        square = np.stack([((x - one) ** 2).sum(axis=1) for one in y], axis=1)
    best = square.argmin(axis=1)
    return best, square[np.arange(len(best)), best].astype(np.int64)


def _decoded(batches: Iterator[pa.RecordBatch], width: int, centroids: np.ndarray, at_once: int = 64):
    """Blocks with their candidates: (batch, row, ids or None, candidate numbers)."""
    for batch in batches:
        for i in range(0, batch.num_rows, at_once):
            part = batch.slice(i, at_once)
            least, most = (np.frombuffer(c.raw(part.column(n))[0].tobytes(), "<i4").reshape(-1, width).astype(np.int64) for n in ("least", "most"))
            for j, row in enumerate(candidates(least, most, centroids)):
                yield part, j, np.flatnonzero(row)


def _vectors(part: pa.RecordBatch, j: int, width: int) -> np.ndarray:
    return np.frombuffer(part.column("vectors")[j].as_buffer(), "<i4").reshape(-1, width)


def sums(zones: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Per centroid that has vectors: their number and the sums of their components."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), np.int64)
        for part, j, open_ in _decoded(batches, width, centroids):
            if len(open_) == 1:
                total[open_[0], :width] += np.frombuffer(part.column("total")[j].as_buffer(), "<i8")
                total[open_[0], width] += len(part.column("ids")[j])
                continue
            v = _vectors(part, j, width)
            own = nearest(v, centroids[open_])[0]
            for m in np.unique(own).tolist():
                total[open_[m], :width] += v[own == m].sum(axis=0, dtype=np.int64)
                total[open_[m], width] += int((own == m).sum())
        some = np.flatnonzero(total[:, width])
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

    rows = zones.mapInArrow(run, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("i", "x"))
    out: dict[int, list[int]] = {}
    for r in rows.groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        out.setdefault(r["cluster"], [0] * (width + 1))[r["i"]] = int(r["x"])
    return {m: (s[width], s[:width]) for m, s in out.items()}


def assigned(zones: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, j, open_ in _decoded(batches, width, centroids):
            best, distance = nearest(_vectors(part, j, width), centroids[open_])
            yield pa.RecordBatch.from_arrays([part.column("ids")[j].values, pa.array(open_[best].astype(np.int32)), pa.array(distance)],
                                             ["vec_id", "cluster", "distance"])

    return zones.mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: str = "2:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, and the number of vectors in the cluster."""
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, width, scale)
    sample = first_vectors(whole, max(k, SAMPLE), seed)
    shape = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, cluster_size long"
    if not sample:
        return spark.createDataFrame([], shape)
    centroids = np.array(sample[:k], np.int64)
    zones = c.settle(blocks(whole, Curve(np.array(sample, float)), width), "zones")
    for _ in range(rounds):
        centroids = centroids.copy()
        for m, (n, total) in sums(zones, centroids).items():
            centroids[m] = [x // n for x in total]
    found = c.settle(assigned(zones, centroids), "assigned")
    of = {r["cluster"]: (r["n"], int(r["d"])) for r in found.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    inertia = sum(d for _, d in of.values())
    # One row per centroid: `k` at most, whatever the table.
    notes = spark.createDataFrame(
        [(m, d, inertia, hashlib.sha256(",".join(map(str, centroids[m].tolist())).encode()).hexdigest(), n) for m, (n, d) in of.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, cluster_size long")
    return found.join(F.broadcast(notes), "cluster").select(*[p.split()[0] for p in shape.split(", ")])
