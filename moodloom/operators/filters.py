"""Row filters and projections. All are plain predicates, so they reach the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flag, names, text_flag
from ..functions.text import has_text
from .series import Order, Spans, ordered, with_position


def drop_empty_text(df: DataFrame, column: str) -> DataFrame:
    return df.where(has_text(column))


def drop_untimed(df: DataFrame, ts: str) -> DataFrame:
    """Read the time column and leave out rows whose time cannot be read."""
    return df.withColumn(ts, F.col(ts).try_cast("timestamp")).where(F.col(ts).isNotNull())


def filter_year(df: DataFrame, ts: str, year: int) -> DataFrame:
    """Rows whose own time lies in the year, as a range so that files can be skipped."""
    stamp = F.col(ts)
    if dict(df.dtypes)[ts] not in ("timestamp", "timestamp_ntz", "date"):
        stamp = stamp.try_cast("timestamp")
    return df.where((stamp >= F.lit(f"{year}-01-01").cast("timestamp"))
                    & (stamp < F.lit(f"{year + 1}-01-01").cast("timestamp")))


def filter_flags(df: DataFrame, keep: str = "keep", empty: str = "is_empty") -> DataFrame:
    """Apply the keep and empty flags that the table has, whatever type they are stored as."""
    if keep in df.columns:
        df = df.where(text_flag(keep))
    if empty in df.columns:
        df = df.where(~text_flag(empty))
    return df


def same_day(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of equal dates; rows whose reference date is unknown stay."""
    return df.where(F.col(b).isNull() | flag(F.to_date(a) == F.to_date(b)))


def date_view(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Closed interval of calendar dates."""
    low, high = F.lit(start).cast("date"), F.lit(end).cast("date")
    return df.where((F.col(column) >= low) & (F.col(column) < F.date_add(high, 1)))


def score_filter(df: DataFrame, score: str, cut: float, core: str | None = None) -> DataFrame:
    """Rows that reach the cut and, if a core column is named, have a core hit."""
    keep = F.col(score) >= cut
    return df.where(keep & (F.col(core) > 0) if core else keep)


def project_final(df: DataFrame, cols: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Choose, order and rename columns."""
    if isinstance(cols, Mapping):
        return df.select(*[F.col(old).alias(new) for old, new in cols.items()])
    return df.select(*cols)


def drop_warmup(df: DataFrame, score: str, keep_warmup: bool = False) -> DataFrame:
    return df if keep_warmup else df.where(F.col(score).isNotNull())


def skip_first_n(df: DataFrame, n: int, order: Order = "date", by: Order | None = None,
                 spans: Spans | None = None) -> DataFrame:
    """Leave out the first n rows of each series."""
    if spans is not None:
        numbered = with_position(df, order, by, spans.block)
        return numbered.where(F.col("_pos") >= n).drop("_pos")
    return df.withColumn("_r", F.row_number().over(ordered(order, names(by)))).where(F.col("_r") > n).drop("_r")
