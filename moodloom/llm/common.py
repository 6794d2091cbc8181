"""Helpers that several operators of this subpackage share.

Texts reach Python tasks as Arrow batches. `pieces_of` cuts a batch into runs of a few megabytes, so that the numpy
arrays of a task stay bounded whatever a batch holds; a single longer text forms a run of its own.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodloom.session import checkpoint_folder, ship_package

RUN_BYTES = 1 << 20
#: Word characters are whatever is not one of these six bytes; all are ASCII, so bytes decide.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the place that driver and executors share."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write once to the shared folder and go on from the written table: a lost executor costs no second run."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_documents(df: DataFrame, columns: Iterable[str] = ("doc_id", "text")) -> DataFrame:
    """Only the columns an operator works on, under its own names: further columns cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def text_key(text: str = "text") -> Column:
    """Identity of a text, null being the empty text: 128 bits of its SHA-256."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)), 1, 16)


# --- Arrow text columns as numpy arrays ----------------------------------------------------------------------------

def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a text or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64)[column.offset:column.offset + n + 1]
    body = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def pieces_of(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = RUN_BYTES,
              rows: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their text bytes: `limit` bytes and `rows` rows at most, or a single row."""
    for batch in batches:
        body, at = raw(batch.column(text))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            j = min(j, i + rows)
            yield batch.slice(i, j - i), body[at[i]:at[j]], at[i:j + 1] - at[i]
            i = j


def spans_of_words(body: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the number of words before it (one entry more than texts).
    `space` tells the bytes between words."""
    inside = np.zeros(len(body) + 2, bool)
    inside[1:-1] = ~space[body]
    first, last = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    if len(body):
        cuts = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(body))]
        both = cuts[inside[cuts] & inside[cuts + 1]]
        first[both], last[both] = True, True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, at, "left")


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values, so that any bits of a hash may be used."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Byte ranges up to this length are hashed side by side, longer ones one by one.
LONG = 64


def eights(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = 0) -> np.ndarray:
    """Bytes 8 chunk .. 8 chunk + 7 of each byte range as a little-endian number; what is beyond a range's end is zero."""
    padded = np.zeros(len(body) + 8, np.uint8)
    padded[:len(body)] = body
    windows = np.lib.stride_tricks.as_strided(padded, (len(body) + 1, 8), (1, 1))
    at = np.minimum(starts + 8 * chunk, len(body))
    left = np.clip(ends - at, 0, 8)
    out = np.ascontiguousarray(windows[at]).view("<u8").ravel()
    return out & np.where(left > 0, U(0xFFFFFFFFFFFFFFFF) >> ((U(8) - left.astype(U)) << U(3)) % U(64), U(0))


def range_hash(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, known: tuple[np.ndarray, ...] = ()) -> np.ndarray:
    """64-bit hash of each byte range; equal ranges hash alike wherever they stand. Short ranges pass eight bytes at a time
    through two scrambled lanes, long ones through BLAKE2b: neither adds up over the bytes, so no regular pattern cancels out.
    `known` are their first `eights`, where a caller has them."""
    sizes = ends - starts
    one, two = mixed(sizes.astype(U) + U(0x9E3779B97F4A7C15)), sizes.astype(U) * U(0xA0761D6478BD642F)
    for chunk in range(-(-int(min(sizes.max(initial=0), LONG)) // 8)):
        at = np.flatnonzero((sizes > 8 * chunk) & (sizes <= LONG)) if chunk else np.arange(len(starts))
        part = known[chunk][at] if chunk < len(known) else eights(body, starts[at], ends[at], chunk)
        one[at] = mixed(one[at] ^ part)
        two[at] = mixed((two[at] + part) * U(0xE7037ED1A0B428DB)) + one[at]
    out = mixed(one * U(0x8EBC6AF09C88C6E3) + (two ^ (two >> U(32))))
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(body[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def words_array(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, space: np.ndarray = SPACE) -> pa.Array:
    """The words that `spans_of_words` found as a binary column."""
    places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(body[~space[body]])])


def word_hash(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word, and for each text the number of words before it (one entry more than texts)."""
    starts, ends, before = spans_of_words(body, at)
    return range_hash(body, starts, ends), before


_BYTE = mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def gram_hash(body: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` bytes, a power of two: halves are scrambled together, so that order is kept."""
    if len(body) < size:
        return np.zeros(0, U)
    out, step = _BYTE[body], 1
    while step < size:
        out = out[:-step] * U(0xA0761D6478BD642F) + out[step:]
        out ^= out >> U(29)
        step *= 2
    return mixed(out)


def lowered(body: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return np.where((body >= 65) & (body <= 90), body + 32, body).astype(np.uint8)


def window_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive word hashes (crossing texts; callers leave those out)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for k in range(size):
        out = (out + words[k:k + n]) * U(0xA0761D6478BD642F)
        out ^= out >> U(29)
    return mixed(out)


def shingles_of(body: np.ndarray, at: np.ndarray, size: int, fold_case: bool) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: `size` words, or the whole sequence of a shorter text."""
    text = lowered(body) if fold_case else body
    words, before = word_hash(text, at)
    full = window_hash(words, size)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(full[a:b - size + 1]))
        elif b > a:
            out.append(mixed(window_hash(words[a:b], b - a) + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def binary(values: Iterable[bytes]) -> pa.Array:
    return pa.array(list(values), pa.binary())


# --- bit tables ----------------------------------------------------------------------------------------------------

#: Bits of a table at most: 16 MB.
TABLE_BITS = 27


def _slots(names: np.ndarray, bits: int) -> np.ndarray:
    return mixed(names.view(U) + U(0x9E3779B97F4A7C15)) >> U(64 - bits)


def listed(table: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Whether the bit of each name (64-bit integers) is set: certainly if it was put in, seldom otherwise."""
    slot = _slots(names, (8 * len(table)).bit_length() - 1)
    return (table[(slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8)) & 1 == 1


def bit_table(rows: DataFrame, name: str, n: int) -> np.ndarray:
    """Bits set for the names in a column: eight for each of n, or 2^TABLE_BITS whatever the table. Each task sets the bits of its
    blocks, and the blocks are all that reaches the driver."""
    bits = min(TABLE_BITS, max(10, (8 * n).bit_length()))
    block = min(bits, 19)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.unique(_slots(batch.column(0).to_numpy(), bits)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((slot >> block).astype(np.int32)), pa.array((slot & ((1 << block) - 1)).astype(np.int32))], ["block", "bit"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            blocks, bit = batch.column("block").to_numpy(), batch.column("bit").to_numpy()
            for b in np.unique(blocks).tolist():
                held.setdefault(b, np.zeros(1 << block, bool))[bit[blocks == b]] = True
        for b, flags in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), binary([np.packbits(flags, bitorder="little").tobytes()])], ["block", "bits"])

    parts = rows.select(name).mapInArrow(slots, "block int, bit int").repartition("block").mapInArrow(fill, "block int, bits binary")
    table = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts.toLocalIterator():
        table[r["block"] << (block - 3):(r["block"] + 1) << (block - 3)] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return table
