"""Packing by concatenating and cutting: prefix sums over partition totals, then fixed windows.

Pass one tokenizes every text, ends it with the end id, and writes the ids with the number of the task that made them
and the ids before them in that task. Pass two adds up the totals of the tasks, which gives each document its place in
the one long stream; windows of `length` ids cut the stream. A document that crosses a window's end leaves a boundary
record on either side. Only the last sequence is padded.

Null and empty texts are documents of one id (the end). Repeated rows are packed once per row. An empty table gives no
pieces. Any further columns are ignored.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

LENGTH, END_ID = 2048, 1
#: Distinct segments a worker meets before it forgets those of the round before.
REMEMBERED = 300_000
#: Bytes of text encoded at once: the more, the fewer segments are looked up.
RUN = 2 << 20
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "padding long")


class SegmentEncoder:
    """Ids of whole texts, each distinct segment being encoded once.

    The byte-level pre-tokenizer always starts anew at a space before a character that is not white space, between a letter
    and a mark, and on either side of line breaks, so ids of a text are the ids of its segments between such places. Only bytes
    that certainly are what they seem count as borders; other text stays in one longer segment.
    """

    BORDER = np.zeros(256, bool)
    BORDER[0x21:0x7F] = True
    BORDER[0xC3:0xE1] = True
    BORDER[0xE4:0xF5] = True
    LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
    LETTER[[*range(65, 91), *range(97, 123)]] = True
    MARK[list(b".,;:!?")] = True

    def __init__(self, file: str, least: int = 1):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.kind = "<u2" if max(self.tokenizer.get_vocab_size(), least + 1) <= 1 << 16 else "<u4"
        size = self.tokenizer.get_vocab_size()
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.seen: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.kind) for e in found]

    def _learn(self, texts: list[bytes]) -> None:
        """Segments with one space, in front, are encoded as one text: its ids that start with a space part it again."""
        plain = [t for t in texts if t[0] == 0x20 and len(t) > 1 and self.BORDER[t[1]] and t.count(b" ") == 1]
        if plain:
            ids = self._ids([b"".join(plain)])[0]
            begins = np.flatnonzero(self.spaced[ids])
            if len(begins) == len(plain):
                width, blob, at = ids.itemsize, ids.tobytes(), [*begins.tolist(), len(ids)]
                self.seen |= {t: blob[a * width:b * width] for t, a, b in zip(plain, at[:-1], at[1:], strict=True)}
        rest = [t for t in texts if t not in self.seen]
        self.seen |= {t: e.tobytes() for t, e in zip(rest, self._ids(rest), strict=True)}

    def __call__(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin."""
        cut = np.zeros(len(body) + 1, bool)
        if len(body) > 1:
            cut[:len(body) - 1] = (body[:-1] == 0x20) & self.BORDER[body[1:]]
            known, line = self.LETTER[body] | self.MARK[body], body == 0x0A
            cut[1:-1] |= (self.LETTER[body[:-1]] & self.MARK[body[1:]]) | (known[:-1] & line[1:]) | (line[:-1] & known[1:])
        cut[at] = True
        cut[len(body)] = False
        starts = np.flatnonzero(cut)
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(at), np.int64)
        ends = np.append(starts[1:], len(body))
        kinds, which = distinct(body, starts, ends)
        data = body.tobytes()
        names = [data[a:b] for a, b in zip(starts[kinds].tolist(), ends[kinds].tolist(), strict=True)]
        if len(self.seen) > REMEMBERED:
            # Segments met since stay for another round, the others are forgotten.
            self.before, self.seen = self.seen, {}
        new = [t for t in names if t not in self.seen]
        self.seen |= {t: self.before[t] for t in new if t in self.before}
        self._learn([t for t in new if t not in self.seen])
        parts = list(map(self.seen.__getitem__, names))
        flat = np.frombuffer(b"".join(parts), self.kind)
        sizes = np.array(list(map(len, parts)), np.int64) // flat.itemsize
        own = sizes[which]
        total = np.concatenate([[0], np.cumsum(own)])
        take = np.repeat((np.cumsum(sizes) - sizes)[which] - total[:-1], own) + np.arange(total[-1])
        return flat[take], total[np.searchsorted(starts, at, "left")]


def distinct(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each distinct byte range, and for every range which of these it equals. Hashes bring equal ones together, but
    bytes decide."""
    parts = c.eights(body, starts, ends), c.eights(body, starts, ends, 1)
    hashes = c.range_hash(body, starts, ends, parts)
    order = np.argsort(hashes)
    new = np.concatenate([[True], hashes[order[1:]] != hashes[order[:-1]]])
    kinds = order[new]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    like = kinds[which]
    sizes = ends - starts
    same = sizes == sizes[like]
    for part in parts:
        same &= part == part[like]
    data = body.tobytes()
    for i in np.flatnonzero((sizes > 16) & same & (like != np.arange(len(like)))).tolist():
        same[i] = data[starts[i]:ends[i]] == data[starts[like[i]]:ends[like[i]]]
    odd = np.flatnonzero(~same)
    which[odd] = len(kinds) + np.arange(len(odd))
    return np.append(kinds, odd), which


@functools.cache
def encoder(file: str, least: int) -> SegmentEncoder:
    """One per worker process, so that its tasks share what it remembers."""
    return SegmentEncoder(file, least)


def tokenized(docs: DataFrame, file: str, end_id: int = END_ID) -> DataFrame:
    """Per row: doc_id, ids (little-endian, two bytes each where the vocabulary allows), and its place in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(file, end_id), TaskContext.get().partitionId(), 0
        kind = encode.kind
        for batch, body, at in c.pieces_of(batches, limit=RUN):
            ids, places = encode(body, at)
            counts = np.diff(places) + 1
            ends = before + np.cumsum(counts)
            own = [np.append(ids[a:b], end_id).astype(kind).tobytes() for a, b in zip(places[:-1], places[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), c.binary(own), pa.array(counts), pa.array(ends - counts),
                 pa.array(np.full(len(own), part, np.int64)), pa.array(np.full(len(own), int(kind[2]), np.int32))],
                ["doc_id", "ids", "tokens", "before", "part", "width"])
            before = int(ends[-1])

    return c.as_documents(docs).mapInArrow(run, "doc_id long, ids binary, tokens long, before long, part long, width int")


def placed(ids: DataFrame) -> DataFrame:
    """Add each document's place in the whole stream. One row per task is summed in order, not one per document; the
    totals have a known size, so the optimizer broadcasts them only where they are small."""
    totals = c.settle(ids.groupBy("part").agg(F.sum("tokens").alias("tokens")), "totals")
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("tokens").over(running), F.lit(0)).alias("base"),
                           F.sum("tokens").over(Window.partitionBy()).alias("stream"))
    return ids.join(c.settle(starts, "starts"), "part").withColumn("place", F.col("base") + F.col("before"))


def _pieces(batch: pa.RecordBatch, at: np.ndarray, length: int) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    """Columns doc_id, start, length, doc_tokens, sequence_id, offset, padding of the pieces of some documents, and where each
    one's bytes begin and end."""
    place, tokens, width = (batch.column(n).to_numpy() for n in ("place", "tokens", "width"))
    first, last = place // length, (place + tokens - 1) // length
    row = np.repeat(np.arange(len(place)), last - first + 1)
    windows = np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[row]
    begin = np.maximum(windows * length, place[row])
    end = np.minimum((windows + 1) * length, (place + tokens)[row])
    start = begin - place[row]
    padding = np.maximum((windows + 1) * length - batch.column("stream").to_numpy()[row], 0)
    bytes_from = at[:-1][row] + start * width[row]
    columns = [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(end - begin), pa.array(tokens[row]), pa.array(windows),
               pa.array(begin % length), pa.array(padding), pa.array(width[row])]
    return columns, bytes_from, bytes_from + (end - begin) * width[row]


def pack(docs: DataFrame, file: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece, with its ids: documents (doc_id, text) cut into sequences of `length` ids."""
    ids = placed(c.settle(tokenized(docs, file, end_id), "ids"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in c.pieces_of(batches, "ids"):
            columns, begin, end = _pieces(batch, at, length)
            data = body.tobytes()
            yield pa.RecordBatch.from_arrays([*columns, c.binary(data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True))],
                                             ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "padding", "width", "ids"])

    return ids.select("doc_id", "ids", "tokens", "place", "width", "stream").mapInArrow(
        cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, padding long, width int, ids binary")


def packed_sums(docs: DataFrame, file: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The pieces of `pack` with the checksum of their ids in place of the ids, which leave Python only once."""
    ids = placed(c.settle(tokenized(docs, file, end_id), "ids"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in c.pieces_of(batches, "ids"):
            columns, begin, end = _pieces(batch, at, length)
            width = batch.column("width")[0].as_py()
            wide = memoryview(np.frombuffer(body, f"<u{width}").astype("<u4").tobytes())
            crc = [zlib.crc32(wide[a:b]) for a, b in zip((begin * 4 // width).tolist(), (end * 4 // width).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns[:3], pa.array(crc, pa.int64()), *columns[3:7]], PIECES.replace(" long", "").split(", "))

    return ids.select("doc_id", "ids", "tokens", "place", "width", "stream").mapInArrow(cut, PIECES)


def checksums(pieces: DataFrame) -> DataFrame:
    """Pieces without their ids: CRC-32 over the ids as unsigned little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(b, f"<u{w}").astype("<u4").tobytes()) for b, w in zip(
                batch.column("ids").to_pylist(), batch.column("width").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("length"), pa.array(crc, pa.int64()),
                 *[batch.column(n) for n in ("doc_tokens", "sequence_id", "offset", "padding")]],
                PIECES.replace(" long", "").split(", "))

    return pieces.mapInArrow(run, PIECES)
