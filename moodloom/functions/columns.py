"""Small column expressions shared by the operators. Missing values are NULL, never NaN."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = str | Column


def names(value: str | Sequence[str] | None) -> list[str]:
    """A column name, a list of them or nothing, as a list."""
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def number(value: ColumnLike) -> Column:
    """Read as a double; unreadable text and NaN become NULL."""
    parsed = col(value).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def flag(condition: Column) -> Column:
    """A comparison that is false where an operand is missing."""
    return F.coalesce(condition, F.lit(False))


def clip(value: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a value; NULL stays NULL (least and greatest alone would skip it)."""
    bounded = value
    if lo is not None:
        bounded = F.greatest(bounded, F.lit(float(lo)))
    if hi is not None:
        bounded = F.least(bounded, F.lit(float(hi)))
    return F.when(value.isNotNull(), bounded)


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient; NULL where the divisor is zero or missing."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def text_flag(value: ColumnLike) -> Column:
    """Truth of a flag stored as boolean, number or text."""
    return flag(F.lower(col(value).cast("string")).isin("true", "1"))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function (Abramowitz-Stegun 7.1.26, error below 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1.0 - series * F.exp(-x * x)
    return 0.5 * (1.0 + F.when(z >= 0, erf).otherwise(-erf))


def lookup(value: Column, mapping: Mapping, default=None) -> Column:
    """Value of a small fixed mapping."""
    table = F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])
    found = F.try_element_at(table, value)
    return found if default is None else F.coalesce(found, F.lit(default))


def steps(value: Column, bounds: Iterable[tuple[float | None, object]]) -> Column:
    """Label of the first bound that exceeds the value; the last bound is open."""
    expression = None
    for bound, label in bounds:
        if bound is None:
            return F.when(value.isNotNull(), expression.otherwise(F.lit(label)))
        branch = value < bound
        expression = F.when(branch, F.lit(label)) if expression is None else expression.when(branch, F.lit(label))
    return expression


def grid(points: Sequence[Mapping[str, object]]) -> Column:
    """Parameter grid as an array of structs: explode it to key every row by each grid point.

    The grid is a literal, so no table is broadcast and no cross join is planned.
    """
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in point.items()]) for point in points])


def computed_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add costly columns so that each row computes them once.

    A filter on a plain column is moved before it, taking a copy of the whole expression along. The
    one-row `inline` keeps filters behind it.
    """
    return df.select("*", F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))


def local_date(ts: ColumnLike, zone: str | None) -> Column:
    """Calendar date of a UTC timestamp in a zone."""
    stamp = col(ts).try_cast("timestamp")
    return F.to_date(F.from_utc_timestamp(stamp, zone) if zone else stamp)
