"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Figures are counted over every whole text. Four rates (integers: a hundred times the characters per word; symbols,
repeated lines and words in repeated windows per ten thousand words) of the documents that pass the base rule go into a
sketch per language and source. A sketch is a histogram whose buckets keep the leading `BITS` bits of a value, so its
quantiles err by less than 1 / 2^(BITS - 1) of the value, and sketches merge by adding counts: those of a language,
and of everything, are sums of the finer ones and stand in where a group has fewer than `LEAST` documents.

Limits are quartiles widened by `FENCE` times the quartile distance and a slack; a rate outside its limits rejects a
document. Sketches and limits are tables, joined to the documents by language and source.

Null and empty texts have no words and fail the base rule. A null language or source is a group of its own. Repeated rows
count once each. An empty table gives no rows. Any further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common as c

BITS, LEAST, FENCE = 7, 200, 3
SYMBOLS = b"#*$%&|<>"
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rate: (expression, slack below the lower limit or None where low values are fine, slack above the upper limit).
RATES = {
    "length": ("100 * word_chars div n_words", 150, 150),
    "symbols": ("10000 * n_symbols div n_words", None, 500),
    "dup_lines": ("10000 * n_dup_lines div n_words", None, 800),
    "repeats": ("10000 * n_repeat_words div n_words", None, 3000),
}


def repeated_words(windows: np.ndarray, n: int) -> int:
    """Words, of n, inside windows of three that occur twice or more."""
    if n < 4:
        return 0
    _, which, counts = np.unique(windows[:n - 2], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:k + n - 2] |= again
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) == 1:
        return 0
    seen, n = set(), 0
    for line in lines:
        if line.strip(b" \t\n\v\f\r"):
            n += line in seen
            seen.add(line)
    return n


def figures(docs: DataFrame, carried: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """`row`, a struct of the carried columns, and the five figures of each whole text."""
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    # A carried text is read from its row: it goes to Python once.
    inner = "text" in carried
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in carried]).alias("row"), *([] if inner else ["text"]))

    def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            yield pa.RecordBatch.from_arrays([row, row.flatten()[carried.index("text")]], ["row", "text"]) if inner else batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in c.pieces_of(with_text(batches)):
            words, before = c.word_hash(body, at)
            windows = c.window_hash(words, 3)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (~c.SPACE[body] & ((body & 0xC0) != 0x80), symbol[body])]
            data = body.tobytes()
            lines = [repeated_lines(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            again = [repeated_words(windows[a:], b - a) for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.diff(before).astype(np.int64)),
                 *(pa.array((s[at[1:]] - s[at[:-1]]).astype(np.int64)) for s in sums), pa.array(lines, pa.int64()), pa.array(again, pa.int64())],
                ["row", *FIGURES])

    return rows.mapInArrow(run, StructType([rows.schema["row"], *[StructField(n, LongType()) for n in FIGURES]]))


def base_passed():
    return F.expr("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words")


def sketches(rated: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Counts per key, rate and bucket; a bucket is named by its smallest value."""
    values = F.explode(F.map_from_arrays(F.array(*[F.lit(r) for r in RATES]), F.array(*[F.col(r) for r in RATES])))
    rows = rated.select(*keys, values.alias("rate", "value"))
    step = F.expr(f"shiftleft(1L, greatest(0, length(bin(value)) - {BITS}))")
    return rows.groupBy(*keys, "rate", (F.col("value") - F.col("value") % step).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, keys: tuple[str, ...], fence: int = FENCE) -> DataFrame:
    """Lower and upper limit of every rate, one row per key, with the documents behind it."""
    group = Window.partitionBy(*keys, "rate")
    ahead = F.sum("n").over(group.orderBy("bucket"))
    ranked = sketch.withColumns({"upto": ahead, "all": F.sum("n").over(group)})
    out = [F.max("all").alias("documents")]
    for name, (_, below, above) in RATES.items():
        q1, q3 = (F.min(F.when((F.col("rate") == name) & (F.col("upto") * 4 >= F.col("all") * k), F.col("bucket"))) for k in (1, 3))
        out.append((q3 + fence * (q3 - q1) + above).alias(f"{name}_most"))
        out.append((q1 - fence * (q3 - q1) - below if below is not None else F.lit(0).cast("long")).alias(f"{name}_least"))
    return ranked.groupBy(*keys).agg(*out)


def group_limits(rows: DataFrame, least: int = LEAST, fence: int = FENCE) -> DataFrame:
    """Limits for each language and source in `rows`, from its own sketch or a merged one."""
    passed = rows.where(base_passed()).select("row.lang", "row.source", *[F.expr(e).alias(n) for n, (e, _, _) in RATES.items()])
    fine = c.settle(sketches(passed, ("lang", "source")), "sketches")
    marks = [f"{n}_{side}" for n in RATES for side in ("least", "most")]
    own, of_lang, of_all = (limits(merged(fine, keys), keys, fence).select(
        *[F.col(k).alias(f"{k}_{i}") for k in keys], F.col("documents").alias(f"documents_{i}"), *[F.col(m).alias(f"{m}_{i}") for m in marks])
        for i, keys in enumerate((("lang", "source"), ("lang",), ())))
    # One row for everything: appended to each group.
    groups = own.join(of_lang, F.col("lang_0").eqNullSafe(F.col("lang_1"))).join(F.broadcast(of_all))

    def pick(mark: str):
        return F.when(F.col("documents_0") >= least, F.col(f"{mark}_0")).when(
            F.col("documents_1") >= least, F.col(f"{mark}_1")).otherwise(F.col(f"{mark}_2")).alias(mark)

    # Written, so that its size is known: it is broadcast where small, and else joined with skewed groups split.
    return c.settle(groups.select(F.col("lang_0").alias("lang"), F.col("source_0").alias("source"), *[pick(m) for m in marks]), "limits")


def judged(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Figures with base_failed and kept. A group without any document that passes the base rule has no limits."""
    g = groups.alias("g")
    joined = rows.join(g, F.col("row.lang").eqNullSafe(F.col("g.lang")) & F.col("row.source").eqNullSafe(F.col("g.source")), "left")
    fits = F.lit(True)
    for name, (rate, _, _) in RATES.items():
        fits = fits & F.expr(f"{rate} between g.{name}_least and g.{name}_most")
    return joined.select("row", *FIGURES, (~base_passed()).alias("base_failed"),
                         F.when(base_passed(), F.coalesce(fits, F.lit(True))).otherwise(F.lit(False)).alias("kept"))


def verdicts(docs: DataFrame, least: int = LEAST, fence: int = FENCE) -> DataFrame:
    rows = c.settle(figures(docs), "figures")
    return judged(rows, group_limits(rows, least, fence)).select("row.doc_id", *FIGURES, "base_failed", "kept")


def kept_documents(docs: DataFrame, least: int = LEAST, fence: int = FENCE) -> DataFrame:
    """The documents that are kept, with all their columns. Texts are read twice rather than shuffled."""
    groups = group_limits(figures(docs), least, fence)
    kept = judged(figures(docs, tuple(docs.columns)), groups).where("kept")
    return kept.select(*[F.col("row").getField(n).alias(n) for n in docs.columns])
