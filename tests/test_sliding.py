"""Sorted sliding frames against the listed frames and against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moodloom.operators import windows as wn
from moodloom.operators.series import Spans
from moodloom.operators.sliding import slide

NUMBERS = st.one_of(st.none(), st.sampled_from([-1.0, 0.0, -0.0, 2.5, float("inf"), float("-inf")]), st.floats(-9, 9))


@settings(max_examples=200, deadline=None)
@given(st.lists(NUMBERS, max_size=40), st.integers(1, 12), st.integers(0, 6))
def test_slide_equals_a_loop(values, n, needed):
    known = np.array([v is not None for v in values], dtype=bool)
    plain = np.array([0.0 if v is None else v for v in values], dtype=float)
    ranks = slide(plain, known, n, needed)
    middles = slide(plain, known, n, needed, 0.5)
    for i in range(len(values)):
        frame = [v for v in values[max(0, i - n + 1):i + 1] if v is not None]
        if len(frame) < max(needed, 1):
            assert ranks[i] is None and middles[i] is None
            continue
        assert ranks[i] == 100.0 * sum(v <= frame[-1] for v in frame) / len(frame)
        ordered, half = sorted(frame), (len(frame) - 1) // 2
        low, high = ordered[half], ordered[len(frame) // 2]
        want = low if low == high else 0.5 * low + 0.5 * high
        assert middles[i] == want or (np.isnan(want) and np.isnan(middles[i]))


def frame(spark, n=260):
    rng = np.random.default_rng(4)
    rows = []
    for g in ("a", "b", None):
        for i in range(n):
            kind = rng.random()
            x = None if kind < 0.2 else float("nan") if kind < 0.22 else float(rng.integers(-4, 5))
            rows.append((g, i, x))
    df = spark.createDataFrame(rows, "g string, at int, x double")
    # Other columns of all kinds travel along, one of them with an awkward name.
    return df.withColumns({"day": F.date_add(F.lit("2020-01-01").cast("date"), F.col("at")), "money": F.col("at").cast("decimal(9,2)"),
                           "many": F.array("at", F.lit(None).cast("int")), "a.b": F.col("g"), "when": F.timestamp_seconds("at")})


def rows_of(df):
    return sorted((str(r) for r in df.collect()))


@pytest.mark.parametrize("spans", [None, Spans("at div 50", 16)])
@pytest.mark.parametrize("n", [1, 7, 60])
def test_same_rows_as_listed_frames(spark, spans, n):
    df = frame(spark)
    order = {"order": "at", "by": "g", "spans": spans}
    for call in (lambda limit: wn.rolling_percent_rank(df, "x", n, 1, name="s", long_frame=limit, **order),
                 lambda limit: wn.rolling_quantile(df, "x", n, 0.7, min_periods=1, name="s", long_frame=limit, **order)):
        listed, kept = call(1000), call(0)
        assert kept.schema.simpleString() == listed.schema.simpleString()
        assert rows_of(kept) == rows_of(listed)


def test_edges(spark):
    df = frame(spark, 30)
    empty = wn.rolling_percent_rank(df.limit(0), "x", 9, 1, "at", "g", long_frame=0)
    assert empty.count() == 0 and empty.columns[-1] == "x_rank9"
    # The result may take the place of its own input; a table without series keys is one series.
    one = df.where("g = 'a'").drop("g")
    replaced = wn.rolling_quantile(one, "x", 9, 0.5, "at", None, 1, "x", long_frame=0)
    assert replaced.columns == one.columns
    assert rows_of(replaced) == rows_of(wn.rolling_quantile(one, "x", 9, 0.5, "at", None, 1, "x", long_frame=99))
    unknown = wn.rolling_percent_rank(one.withColumn("x", F.lit(None).cast("double")), "x", 9, 1, "at", long_frame=0)
    assert unknown.where("x_rank9 is not null").count() == 0
