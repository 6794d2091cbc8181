"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash space is kept.

Which hashes are kept depends on the hash alone, so sketches of any two texts sample the same shingles, the share of one
sketch found in another estimates containment whatever the sizes, and the sketch of a union is the union of sketches.
A fingerprint is `words.digest.hashes`: the number of distinct shingles, eight hex digits of the text's SHA-256, and the
kept hashes (five bytes each, sorted, Base64). Shingles have five words (a shorter text is one shingle).

Null and empty texts have the empty sketch. Texts of few shingles may keep no hash; then only equal texts are alike.
Documents are ordered by descending id, equal ids by their text's digest; null ids come last. Repeated rows are documents
of their own. A single document is its own next one. An empty table gives no rows. Any further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

WORDS, ONE_IN = 5, 4
COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


class Sketch:
    """Kept hashes (40 leading bits each, sorted), distinct shingles in all, and the text's digest."""

    def __init__(self, hashes: np.ndarray, shingles: int, digest: str):
        self.hashes, self.shingles, self.digest = hashes, shingles, digest

    def text(self) -> str:
        five = self.hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
        return f"{self.shingles}.{self.digest[:8]}.{base64.b64encode(five).decode()}"

    @staticmethod
    def parse(text: str) -> Sketch:
        shingles, digest, body = text.split(".")
        five = np.frombuffer(base64.b64decode(body), np.uint8).reshape(-1, 5)
        wide = np.zeros((len(five), 8), np.uint8)
        wide[:, :5] = five
        return Sketch(wide.view("<u8").ravel().astype(np.uint64), int(shingles), digest)

    def shared(self, other: Sketch) -> int:
        return len(np.intersect1d(self.hashes, other.hashes, assume_unique=True))

    def containment(self, other: Sketch) -> float:
        """Share of this text's shingles that the other has."""
        return self.shared(other) / len(self.hashes) if len(self.hashes) else 0.0

    def union(self, other: Sketch) -> np.ndarray:
        return np.union1d(self.hashes, other.hashes)

    def near(self, other: Sketch) -> float:
        """Containment of the smaller sketch in the larger one; 1 for equal texts."""
        if self.digest[:8] == other.digest[:8] and self.shingles == other.shingles:
            return 1.0
        least = min(len(self.hashes), len(other.hashes))
        return self.shared(other) / least if least else 0.0


def sketches(texts: list[bytes], words: int = WORDS, one_in: int = ONE_IN) -> list[Sketch]:
    out: list[Sketch] = []
    at, body = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64), b"".join(texts)
    found = c.shingles_of(np.frombuffer(body, np.uint8), at, words, fold_case=False)
    most = np.uint64(min((1 << 64) // one_in, (1 << 64) - 1))
    for text, own in zip(texts, found, strict=True):
        kept = own[:np.searchsorted(own, most, "left")] >> np.uint64(24)
        out.append(Sketch(np.unique(kept), len(own), hashlib.sha256(text).hexdigest()))
    return out


def fingerprints(docs: DataFrame, words: int = WORDS, one_in: int = ONE_IN) -> DataFrame:
    """doc_id, shingles and fingerprint of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in c.pieces_of(batches):
            data = body.tobytes()
            own = sketches([data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], words, one_in)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.text() for s in own])], ["doc_id", "fingerprint"])

    return c.as_documents(docs).mapInArrow(run, "doc_id long, fingerprint string")


def with_neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Documents dealt out by ranges of ids, each range with its successor's first document as a boundary record.

    Rows carry the range (0 has the largest ids) and `guest`. Only range borders and first documents, one per range,
    pass through the driver; texts are shuffled once.
    """
    spark = docs.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = c.as_documents(docs).withColumn("key", c.text_key())
    borders = docs.select(F.percentile_approx("doc_id", F.lit([i / parts for i in range(1, parts)] or [0.5]), 100 * parts)).first()[0] or []
    borders = sorted(set(borders), reverse=True)
    place = F.coalesce(F.size(F.filter(F.array(*[F.lit(b) for b in borders]), lambda b: b >= F.col("doc_id"))), F.lit(len(borders))) if borders else F.lit(0)
    # A null id counts as smaller than every border.
    place = F.when(F.col("doc_id").isNull(), F.lit(len(borders))).otherwise(place).cast("int")
    dealt = docs.withColumn("range", place)
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"), F.col("key"))
    firsts = sorted(dealt.groupBy("range").agg(F.max(order).alias("first")).select(
        "range", "first.doc_id", "first.key").collect(), key=lambda r: r["range"])
    to = [(r["doc_id"], bytes(r["key"]), firsts[i - 1]["range"]) for i, r in enumerate(firsts)]
    # One row per range, so the broadcast is as small as the list of partitions.
    guests = F.broadcast(spark.createDataFrame(to, "first_id long, first_key binary, host int"))
    hit = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key"))
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("host").alias("range"), F.lit(True).alias("guest"))
    rows = dealt.join(guests, hit, "left").withColumn(
        "to", F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    rows = rows.select("to.range", "to.guest", "doc_id", "key", "text")
    return rows.repartition(parts, "range").sortWithinPartitions(
        "range", "guest", F.col("doc_id").desc_nulls_last(), F.col("key").desc())


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the following text's beginning."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def edits(docs: DataFrame, words: int = WORDS, one_in: int = ONE_IN) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done(following: str) -> pa.RecordBatch:
            texts = [h[1] for h in held]
            changed = [edited(t, n).encode() for t, n in zip(texts, [*texts[1:], following], strict=True)]
            own = sketches([t.encode() for t in [*texts, following]], words, one_in)
            new = sketches(changed, words, one_in)
            columns = [[h[0] for h in held], [len(t) for t in texts], [s.digest for s in new], [s.text() for s in own[:-1]],
                       [s.text() for s in new], [a.near(b) for a, b in zip(own, new, strict=False)],
                       [a.near(b) for a, b in zip(own, own[1:], strict=False)]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], list(COLUMNS))

        for batch in batches:
            guests, ids, texts = (batch.column(n) for n in ("guest", "doc_id", "text"))
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                guest = guests[i].as_py()
                if held and (guest or size > c.RUN_BYTES):
                    yield done(text)
                    held, size = [], 0
                if not guest:
                    held.append((ids[i].as_py(), text))
                    size += len(text)

    return with_neighbours(docs).mapInArrow(run, SCHEMA)
