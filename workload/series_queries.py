"""Queries over ordered series: daily prices per order priority, with gaps, and event-level series."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodloom.operators import aggregates as ag
from moodloom.operators import falls as fa
from moodloom.operators import filters as fl
from moodloom.operators import joining as jn
from moodloom.operators import windows as wn
from moodloom.operators.series import Spans, running, with_position
from moodloom.sources import tables as tb

from .base import COMMENTS, DAILY, GAPPY, PRICES, comments, daily, gappy, market, mood, prices, query, table

W = "PARTITION BY series ORDER BY date"
BY = {"by": "series"}
# Events are not daily: one event type may hold any number of rows, so its series is cut into spans.
EVENT_SPANS = Spans("to_date(ts)", 512)
EW = "PARTITION BY event_type ORDER BY ts, event_id"


def events(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "event_type", "value")


@query("lags", f"""
SELECT series, date, lag(x, 3) OVER (w) AS x_lag3, lead(x, 2) OVER (w) AS x_lead2 FROM gappy WINDOW w AS ({W})""".replace("(w)", "w"),
       doubles="x_lag3 x_lead2", with_=f"WITH {GAPPY}")
def lags(spark, sf):
    d = wn.lags(wn.lags(gappy(spark, sf), "x", 3, **BY), "x", -2, **BY)
    return d.select("series", "date", "x_lag3", "x_lead2")


@query("returns", f"""
SELECT series, date, x - lag(x, 2) OVER w AS x_diff2, p / lag(p, 2) OVER w - 1 AS x_pct2,
  x / lag(x, 2) OVER w - 1 AS plain, ln(close / lag(close) OVER w) AS close_log1
FROM (SELECT *, last_value(x IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS p FROM gappy) AS q WINDOW w AS ({W})""",
       doubles="x_diff2 x_pct2 plain close_log1", with_=f"WITH {GAPPY}")
def returns(spark, sf):
    d = wn.returns(gappy(spark, sf), "x", 2, "diff", **BY)
    d = wn.returns(d, "x", 2, "pct", **BY)
    d = wn.returns(d, "x", 2, "pct", pad=False, name="plain", **BY)
    return wn.returns(d, "close", 1, "log", **BY).select("series", "date", "x_diff2", "x_pct2", "plain", "close_log1")


@query("ffill_bfill", f"""
SELECT series, date, coalesce(last_value(x IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING),
  first_value(x IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM gappy""",
       doubles="x", with_=f"WITH {GAPPY}")
def ffill_bfill(spark, sf):
    return wn.ffill_bfill(gappy(spark, sf).select("series", "date", "x"), "x", **BY)


@query("rolling_stats", f"""
SELECT series, date,
  CASE WHEN n >= 5 THEN avg(x) OVER f END AS x_mean7, CASE WHEN n >= 5 THEN sum(x) OVER f END AS x_sum7,
  CASE WHEN n >= 5 THEN stddev_samp(x) OVER f END AS x_std7, CASE WHEN n >= 5 THEN min(x) OVER f END AS x_min7,
  CASE WHEN n >= 5 THEN max(x) OVER f END AS x_max7, CASE WHEN n >= 5 THEN n END AS x_count7
FROM (SELECT *, count(x) OVER ({W} ROWS 6 PRECEDING) AS n FROM gappy) AS q
WINDOW f AS ({W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""", doubles="x_mean7 x_sum7 x_std7 x_min7 x_max7", with_=f"WITH {GAPPY}")
def rolling_stats(spark, sf):
    d = wn.rolling_stats(gappy(spark, sf), "x", 7, ("mean", "sum", "std", "min", "max", "count"), 5, **BY)
    return d.select("series", "date", *[f"x_{f}7" for f in ("mean", "sum", "std", "min", "max", "count")])


@query("rolling_stats_spans", f"""
SELECT event_id, CASE WHEN n = 50 THEN avg(value) OVER f END AS value_mean50, CASE WHEN n = 50 THEN max(value) OVER f END AS value_max50
FROM (SELECT *, count(value) OVER ({EW} ROWS 49 PRECEDING) AS n FROM events) AS q
WINDOW f AS ({EW} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""", doubles="value_mean50 value_max50", digits=5)
def rolling_stats_spans(spark, sf):
    d = wn.rolling_stats(events(spark, sf), "value", 50, ("mean", "max"), None, ["ts", "event_id"], "event_type",
                         EVENT_SPANS)
    return d.select("event_id", "value_mean50", "value_max50")


@query("running_spans", f"""
SELECT event_id, row_number() OVER ({EW}) - 1 AS pos, sum(value) OVER ({EW} ROWS UNBOUNDED PRECEDING) AS total,
  max(value) OVER ({EW} ROWS UNBOUNDED PRECEDING) AS peak,
  last_value(CASE WHEN value > 90 THEN value END IGNORE NULLS) OVER ({EW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_big
FROM events""", doubles="total peak last_big")
def running_spans(spark, sf):
    d = running(events(spark, sf), {
        "total": ("sum", F.col("value")), "peak": ("max", F.col("value")),
        "last_big": ("last", F.when(F.col("value") > 90, F.col("value")), -1)}, ["ts", "event_id"], "event_type", EVENT_SPANS)
    d = with_position(d, ["ts", "event_id"], "event_type", "to_date(ts)", "pos")
    return d.select("event_id", "pos", "total", "peak", "last_big")


@query("rolling_quantile", f"""
SELECT series, date, CASE WHEN count(x) OVER f >= 40 THEN quantile_cont(x, 0.7) OVER f END AS x_q70_60
FROM gappy WINDOW f AS ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""", doubles="x_q70_60", with_=f"WITH {GAPPY}")
def rolling_quantile(spark, sf):
    return wn.rolling_quantile(gappy(spark, sf), "x", 60, 0.7, min_periods=40, **BY).select("series", "date", "x_q70_60")


RANK = """CASE WHEN len(known) >= {mp} THEN 100.0 * len(list_filter(known, lambda v: v <= known[-1])) / len(known) END"""


@query("rolling_percent_rank", f"""
SELECT series, date, {RANK.format(mp=30)} AS x_rank100
FROM (SELECT series, date, list_filter(list(x) OVER ({W} ROWS 99 PRECEDING), lambda v: v IS NOT NULL) AS known FROM gappy) AS q""",
       doubles="x_rank100", with_=f"WITH {GAPPY}")
def rolling_percent_rank(spark, sf):
    return wn.rolling_percent_rank(gappy(spark, sf), "x", 100, 30, **BY).select("series", "date", "x_rank100")


LONG = "(SELECT event_id, event_type, ts, CASE WHEN value >= 5 THEN value END AS v FROM events) AS e"


def long_events(spark, sf):
    return events(spark, sf).withColumn("v", F.when(F.col("value") >= 5, F.col("value")))


@query("rolling_quantile_long", f"""
SELECT event_id, CASE WHEN count(v) OVER f >= 100 THEN quantile_cont(v, 0.7) OVER f END AS v_q70_1000
FROM {LONG} WINDOW f AS ({EW} ROWS 999 PRECEDING)""", doubles="v_q70_1000")
def rolling_quantile_long(spark, sf):
    return wn.rolling_quantile(long_events(spark, sf), "v", 1000, 0.7, ["ts", "event_id"], "event_type", 100,
                               spans=EVENT_SPANS).select("event_id", "v_q70_1000")


@query("rolling_percent_rank_long", f"""
SELECT event_id, {RANK.format(mp=100)} AS v_rank1000
FROM (SELECT event_id, list_filter(list(v) OVER ({EW} ROWS 999 PRECEDING), lambda v: v IS NOT NULL) AS known FROM {LONG}) AS q""",
       doubles="v_rank1000")
def rolling_percent_rank_long(spark, sf):
    return wn.rolling_percent_rank(long_events(spark, sf), "v", 1000, 100, ["ts", "event_id"], "event_type",
                                   spans=EVENT_SPANS).select("event_id", "v_rank1000")


def cdf_sql(z: str) -> str:
    """Normal distribution function by the same published approximation."""
    t = f"(1.0 / (1.0 + 0.3275911 * (abs({z}) / sqrt(2.0))))"
    poly = (f"{t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429))))")
    return f"0.5 * (1.0 + (CASE WHEN {z} >= 0 THEN 1.0 ELSE -1.0 END) * (1.0 - {poly} * exp(-({z}) * ({z}) / 2.0)))"


@query("rolling_z_cdf", f"""
SELECT series, date, CASE WHEN z IS NOT NULL THEN 100.0 * ({cdf_sql('z')}) END AS x_cdf100
FROM (SELECT series, date, CASE WHEN x IS NOT NULL AND count(x) OVER f >= 30 THEN
        least(greatest((x - avg(x) OVER f) / nullif(stddev_samp(x) OVER f, 0), -2.0), 2.0) END AS z
      FROM gappy WINDOW f AS ({W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) AS q""", doubles="x_cdf100", with_=f"WITH {GAPPY}")
def rolling_z_cdf(spark, sf):
    return wn.rolling_z_cdf(gappy(spark, sf), "x", 100, 30, 2.0, **BY).select("series", "date", "x_cdf100")


EWM = """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS rn FROM gappy),
ewm AS (
  SELECT series, date, rn, x AS y, CAST(1.0 AS DOUBLE) AS w FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.series, n.date, n.rn,
    CASE WHEN e.y IS NULL THEN n.x WHEN n.x IS NULL THEN e.y
         ELSE (0.9 * e.w * e.y + 0.1 * n.x) / (0.9 * e.w + 0.1) END,
    CASE WHEN e.y IS NULL OR n.x IS NOT NULL THEN CAST(1.0 AS DOUBLE) ELSE 0.9 * e.w END
  FROM ewm AS e JOIN numbered AS n ON n.series = e.series AND n.rn = e.rn + 1)"""


@query("ewm", "SELECT series, date, y AS x_ewm FROM ewm", doubles="x_ewm", with_="WITH RECURSIVE " + GAPPY + EWM)
def ewm(spark, sf):
    return wn.ewm(gappy(spark, sf), "x", 0.1, **BY).select("series", "date", "x_ewm")


@query("ewm_spans", """
SELECT event_id, y AS value_ewm FROM ewm""", doubles="value_ewm", with_="""WITH RECURSIVE
numbered AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
ewm AS (
  SELECT event_id, event_type, rn, value AS y FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.event_id, n.event_type, n.rn, 0.6 * e.y + 0.4 * n.value
  FROM ewm AS e JOIN numbered AS n ON n.event_type = e.event_type AND n.rn = e.rn + 1)""")
def ewm_spans(spark, sf):
    return wn.ewm(events(spark, sf), "value", 0.4, ["ts", "event_id"], "event_type", spans=EVENT_SPANS).select(
        "event_id", "value_ewm")


@query("forward_sum", f"""
SELECT series, date, CASE WHEN count(x) OVER f = 5 THEN sum(x) OVER f END AS x_next5
FROM gappy WINDOW f AS ({W} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)""", doubles="x_next5", with_=f"WITH {GAPPY}")
def forward_sum(spark, sf):
    return wn.forward_sum(gappy(spark, sf), "x", 5, **BY).select("series", "date", "x_next5")


@query("lag_features", f"""
SELECT * FROM (SELECT series, date, lag(x) OVER w AS x, lag(close) OVER w AS close, volume FROM gappy WINDOW w AS ({W})) AS q
WHERE x IS NOT NULL AND close IS NOT NULL""", doubles="x close", with_=f"WITH {GAPPY}")
def lag_features(spark, sf):
    return wn.lag_features(gappy(spark, sf), ["x", "close"], **BY).select("series", "date", "x", "close", "volume")


RETURNS = GAPPY + f""",
rets AS (SELECT series, date, CASE WHEN x IS NULL THEN NULL ELSE ln(close / lag(close) OVER ({W})) / 50.0 END AS r FROM gappy)"""


def rets(spark, sf):
    d = wn.returns(gappy(spark, sf), "close", 1, "log", name="r", **BY)
    return d.select("series", "date", F.when(F.col("x").isNotNull(), F.col("r") / 50.0).alias("r"))


@query("drawdown", """
SELECT series, date, growth, peak, growth / peak - 1 AS drawdown
FROM (SELECT *, max(growth) OVER (PARTITION BY series ORDER BY date) AS peak
      FROM (SELECT series, date, CASE WHEN r IS NOT NULL THEN exp(sum(r) OVER (PARTITION BY series ORDER BY date)) END AS growth FROM rets) AS g) AS q""",
       doubles="growth peak drawdown", with_=f"WITH {RETURNS}")
def drawdown(spark, sf):
    return wn.drawdown(rets(spark, sf), "r", **BY).select("series", "date", "growth", "peak", "drawdown")


@query("max_drawdown", """
SELECT series, count(*) AS rows, min(growth / peak - 1) AS mdd
FROM (SELECT *, max(growth) OVER (PARTITION BY series ORDER BY date) AS peak
      FROM (SELECT series, date, CASE WHEN r IS NOT NULL THEN exp(sum(r) OVER (PARTITION BY series ORDER BY date)) END AS growth FROM rets) AS g) AS q
WHERE growth IS NOT NULL GROUP BY series""", doubles="mdd", with_=f"WITH {RETURNS}")
def max_drawdown(spark, sf):
    return fa.max_drawdown(rets(spark, sf), "r", blocks=["date_trunc('month', date)", "date_trunc('year', block)"], **BY)


@query("max_drawdown_events", f"""
SELECT event_type, count(*) AS rows, min(growth / peak - 1) AS mdd
FROM (SELECT *, max(growth) OVER ({EW}) AS peak
      FROM (SELECT event_type, ts, event_id, exp(sum((value - 50.0) / 10000.0) OVER ({EW})) AS growth FROM events WHERE value IS NOT NULL) AS g) AS q
GROUP BY event_type""", doubles="mdd")
def max_drawdown_events(spark, sf):
    d = events(spark, sf).withColumn("r", (F.col("value") - 50.0) / 10000.0)
    return fa.max_drawdown(d, "r", ["ts", "event_id"], "event_type", ["date_trunc('hour', ts)", "to_date(block)"])


NAV = """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS rn FROM rets),
acc AS (
  SELECT series, date, rn, 1000.0 * exp(coalesce(r, 0.0)) AS nav, 1000.0 AS contributed FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.series, n.date, n.rn,
    (a.nav + CASE WHEN date_trunc('month', n.date) <> date_trunc('month', a.date) THEN 25.0 ELSE 0.0 END) * exp(coalesce(n.r, 0.0)),
    a.contributed + CASE WHEN date_trunc('month', n.date) <> date_trunc('month', a.date) THEN 25.0 ELSE 0.0 END
  FROM acc AS a JOIN numbered AS n ON n.series = a.series AND n.rn = a.rn + 1)"""


@query("account_nav", "SELECT series, date, CAST(nav AS DOUBLE) AS nav, CAST(contributed AS DOUBLE) AS contributed FROM acc",
       doubles="nav contributed", with_="WITH RECURSIVE " + RETURNS + NAV)
def account_nav(spark, sf):
    return wn.account_nav(rets(spark, sf), "r", 1000.0, 25.0, by="series").select("series", "date", "nav", "contributed")


@query("neg_z", f"""
SELECT series, date, CASE WHEN count(x) OVER f >= 20 THEN (x - avg(x) OVER f) / (stddev_samp(x) OVER f + 1e-8) END AS x_z
FROM gappy WINDOW f AS ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""", doubles="x_z", with_=f"WITH {GAPPY}")
def neg_z(spark, sf):
    return wn.rolling_z(gappy(spark, sf), "x", 60, 20, **BY).select("series", "date", "x_z")


@query("heat", """
SELECT series, date, (x - avg(x) OVER w) / (stddev_samp(x) OVER w + 1e-8) * (close - avg(close) OVER w) / (stddev_samp(close) OVER w + 1e-8) AS heat
FROM gappy WINDOW w AS (PARTITION BY series)""", doubles="heat", with_=f"WITH {GAPPY}")
def heat(spark, sf):
    return wn.heat(gappy(spark, sf), "x", "close", "series").select("series", "date", "heat")


@query("topk_per_group", """
SELECT event_type, user_id, total, rank FROM (
  SELECT event_type, user_id, max(value) AS total,
    row_number() OVER (PARTITION BY event_type ORDER BY max(value) DESC, user_id) AS rank
  FROM events GROUP BY 1, 2) AS q WHERE rank <= 10""", doubles="total")
def topk_per_group(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "user_id", F.col("value").alias("total"))
    return wn.topk_per_group(rows, "event_type", "total", "user_id", 10).select(
        "event_type", "user_id", "total", F.col("rank").cast("bigint"))


@query("last_n", """
SELECT series, date, close FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS r FROM prices) AS q WHERE r <= 20""",
       doubles="close", with_=f"WITH {PRICES}")
def last_n(spark, sf):
    return wn.last_n(prices(spark, sf), 20, **BY).select("series", "date", "close")


@query("calendar_parts", """
SELECT series, date, CAST(isodow(date) - 1 AS BIGINT) AS dayofweek, month(date) AS month, year(date) AS year FROM prices""",
       with_=f"WITH {PRICES}")
def calendar_parts(spark, sf):
    return wn.calendar_parts(prices(spark, sf)).select(
        "series", "date", *[F.col(c).cast("bigint") for c in ("dayofweek", "month", "year")])


@query("skip_first_n", """
SELECT series, date, close FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS r FROM prices) AS q WHERE r > 37""",
       doubles="close", with_=f"WITH {PRICES}")
def skip_first_n(spark, sf):
    return fl.skip_first_n(prices(spark, sf), 37, **BY).select("series", "date", "close")


# --- sources, filters and joins over dated tables --------------------------------------------------

@query("normalize_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders")
def normalize_date(spark, sf):
    day = F.col("o_orderdate").cast("date")
    kinds = ["yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "yyyy.MM.dd", "yyyy-MM-dd HH:mm:ss"]
    spelled = F.coalesce(*[F.when(F.col("o_orderkey") % len(kinds) == i, F.date_format(day, k)) for i, k in enumerate(kinds)])
    return tb.normalize_date(table(spark, sf, "orders").select("o_orderkey", spelled.alias("Date")), strict=True)


@query("date_spine", """
SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d
FROM (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events) AS e) AS q""")
def date_spine(spark, sf):
    return tb.date_spine(table(spark, sf, "events"), "ts")


@query("filter_year", "SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1997", doubles="o_totalprice")
def filter_year(spark, sf):
    return fl.filter_year(table(spark, sf, "orders"), "o_orderdate", 1997).select("o_orderkey", "o_totalprice")


@query("drop_untimed", """
SELECT event_id, ts FROM events WHERE event_type <> 'error'""")
def drop_untimed(spark, sf):
    text = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", "soon").otherwise(F.col("ts").cast("string")).alias("ts"))
    return fl.drop_untimed(text, "ts")


@query("same_day", """
SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE CAST(l_shipdate AS DATE) = CAST(o_orderdate AS DATE)""")
def same_day(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return fl.same_day(joined, "l_shipdate", "o_orderdate").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"))


@query("date_view", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1996-05-31'")
def date_view(spark, sf):
    return fl.date_view(table(spark, sf, "orders"), "o_orderdate", "1996-02-01", "1996-05-31").select("o_orderkey")


@query("project_final", "SELECT o_orderkey AS news_id, o_orderpriority AS section, o_totalprice AS amount FROM orders",
       doubles="amount")
def project_final(spark, sf):
    return fl.project_final(table(spark, sf, "orders"), {
        "o_orderkey": "news_id", "o_orderpriority": "section", "o_totalprice": "amount"})


@query("outer_chain", """
SELECT date, close, sub_index6, shipped FROM market FULL JOIN mood USING (date)
FULL JOIN (SELECT CAST(ts AS DATE) AS date, count(*) AS shipped FROM events GROUP BY 1) AS e USING (date)""",
       doubles="close sub_index6", with_=f"WITH {DAILY}")
def outer_chain(spark, sf):
    third = table(spark, sf, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("shipped"))
    return jn.outer_chain([market(spark, sf), mood(spark, sf), third]).select("date", "close", "sub_index6", "shipped")


@query("left_merge", "SELECT date, close, sub_index6, sent_std FROM market LEFT JOIN mood USING (date)",
       doubles="close sub_index6 sent_std", with_=f"WITH {DAILY}")
def left_merge(spark, sf):
    return jn.left_merge(market(spark, sf), mood(spark, sf)).select("date", "close", "sub_index6", "sent_std")


@query("map_lookup", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1.2 WHEN 'O' THEN 0.7 ELSE 0.0 END::DOUBLE AS multiplier FROM orders""",
       doubles="multiplier")
def map_lookup(spark, sf):
    return jn.map_lookup(table(spark, sf, "orders"), "o_orderstatus", {"F": 1.2, "O": 0.7}, 0.0, "multiplier").select(
        "o_orderkey", "multiplier")


@query("asof_compare", """
SELECT series, point, date, close FROM (
  SELECT t.series, t.point, coalesce(p.date, f.date) AS date, coalesce(p.close, f.close) AS close
  FROM targets AS t ASOF LEFT JOIN prices AS p ON t.series = p.series AND t.target >= p.date
  JOIN firsts AS f ON f.series = t.series) AS q""", doubles="close", with_=f"""WITH {PRICES},
ends AS (SELECT series, max(date) AS latest FROM prices GROUP BY series),
firsts AS (SELECT series, min(date) AS date, arg_min(close, date) AS close FROM prices GROUP BY series),
targets AS (
  SELECT series, 'latest' AS point, latest AS target FROM ends
  UNION ALL SELECT series, 'previous', latest - 1 FROM ends
  UNION ALL SELECT series, '1 week', latest - 7 FROM ends
  UNION ALL SELECT series, '1 month', CAST(latest - INTERVAL 1 MONTH AS DATE) FROM ends
  UNION ALL SELECT series, '1 year', CAST(latest - INTERVAL 1 YEAR AS DATE) FROM ends)""")
def asof_compare(spark, sf):
    return jn.asof_compare(prices(spark, sf), "date", "close", by="series")


@query("compare_series", """
SELECT corr(a.close, b.close) AS corr, avg(abs(a.close - b.close)) AS mad, max(abs(a.close - b.close)) AS maxabs, count(*) AS n
FROM prices AS a JOIN prices AS b USING (date) WHERE a.series = '1-URGENT' AND b.series = '2-HIGH'""",
       doubles="corr mad maxabs", with_=f"WITH {PRICES}")
def compare_series(spark, sf):
    d = prices(spark, sf)
    return jn.compare_series(d.where("series = '1-URGENT'"), d.where("series = '2-HIGH'"), "date", "close")


@query("swap_columns", f"""
SELECT series, date, last_value(x IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS close
FROM (SELECT p.series, p.date, g.x FROM prices AS p LEFT JOIN (SELECT * FROM gappy WHERE volume > 1) AS g USING (series, date)) AS q""",
       doubles="close", with_=f"WITH {GAPPY}")
def swap_columns(spark, sf):
    fresh = gappy(spark, sf).where("volume > 1").select("series", "date", F.col("x").alias("close"))
    return jn.swap_columns(prices(spark, sf).drop("volume"), fresh, ["close"], "date", "series")


@query("expanding_blocks", """
SELECT series, block, count(*) AS rows_read, max(pos) AS last_pos FROM (
  SELECT series, pos, unnest(generate_series(greatest(pos // 128, 0), (n - 1) // 128)) AS block
  FROM (SELECT series, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY series) AS n
        FROM prices) AS q) AS b GROUP BY 1, 2""", with_=f"WITH {PRICES}")
def expanding_blocks(spark, sf):
    blocks = jn.expanding_blocks(prices(spark, sf), "date", 60, 128, "series")
    return blocks.groupBy("series", F.col("_block").cast("bigint").alias("block")).agg(
        F.count(F.lit(1)).alias("rows_read"), F.max("_pos").cast("bigint").alias("last_pos"))


# --- aggregates over scored comments -----------------------------------------------------------------

DAY = "CAST(comment_at + INTERVAL 9 HOUR AS DATE)"
DAILY_SENT = COMMENTS + f""",
c AS (SELECT *, {DAY} AS date, greatest(coalesce(TRY_CAST(weight AS DOUBLE), 1.0), 0.0) AS w,
        p_pos - p_neg AS raw, (p_pos - p_neg) / (p_pos + p_neg + 1e-8) AS norm FROM comments),
d0 AS (
  SELECT date, count(comment_id) AS comment_count, sum(w) AS weight_sum, sum(w * w) AS weight_sq_sum,
    avg(raw) AS sent_raw_mean, avg(norm) AS sent_norm_mean, stddev_samp(raw) AS sent_std, avg(p_pos) AS p_pos_mean,
    avg(p_neu) AS p_neu_mean, avg(p_neg) AS p_neg_mean, sum(raw * w) / (sum(w) + 1e-8) AS sent_raw_mean_w,
    sum(norm * w) / (sum(w) + 1e-8) AS sent_norm_w, sum(p_pos * w) / (sum(w) + 1e-8) AS pos_mean_w,
    sum(p_neg * w) / (sum(w) + 1e-8) AS neg_mean_w
  FROM c GROUP BY date),
d1 AS (
  SELECT *, pos_mean_w + neg_mean_w AS sent_strength_w, neg_mean_w AS neg_score,
    weight_sum * weight_sum / (weight_sq_sum + 1e-8) AS effective_n,
    ln(1 + weight_sum * weight_sum / (weight_sq_sum + 1e-8)) AS log_effective_n FROM d0),
d2 AS (
  SELECT *, CASE WHEN count(neg_score) OVER f >= 20 THEN (neg_score - avg(neg_score) OVER f) / (stddev_samp(neg_score) OVER f + 1e-8) END AS neg_z,
    (sent_strength_w - avg(sent_strength_w) OVER ()) / (stddev_samp(sent_strength_w) OVER () + 1e-8)
    * ((log_effective_n - avg(log_effective_n) OVER ()) / (stddev_samp(log_effective_n) OVER () + 1e-8)) AS heat
  FROM d1 WINDOW f AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""
SENT_COLUMNS = ("weight_sum weight_sq_sum sent_raw_mean sent_norm_mean sent_std p_pos_mean p_neu_mean p_neg_mean "
                "sent_raw_mean_w sent_norm_w pos_mean_w neg_mean_w sent_strength_w neg_score effective_n log_effective_n neg_z heat")


@query("daily_sentiment", "SELECT * FROM d2", doubles=SENT_COLUMNS, with_=f"WITH {DAILY_SENT}")
def daily_sentiment(spark, sf):
    return ag.daily_sentiment(comments(spark, sf), "comment_at", "p_pos", "p_neu", "p_neg", "weight", key="comment_id")


@query("sentiment_columns", """
SELECT comment_id, p_pos - p_neg AS sentiment_raw,
  least(greatest((p_pos - p_neg) / (p_pos + p_neg + 1e-8), -1.0), 1.0) AS sentiment_norm,
  CASE WHEN p_neg >= p_neu AND p_neg >= p_pos THEN 'neg' WHEN p_neu >= p_pos THEN 'neu' ELSE 'pos' END AS sentiment_label
FROM comments""", doubles="sentiment_raw sentiment_norm", with_=f"WITH {COMMENTS}")
def sentiment_columns(spark, sf):
    from moodloom.operators.classify import sentiment_columns as add

    return add(comments(spark, sf)).select("comment_id", "sentiment_raw", "sentiment_norm", "sentiment_label")


@query("label_counts", """
SELECT event_type, CASE WHEN p_neg >= p_neu AND p_neg >= p_pos THEN 'neg' WHEN p_neu >= p_pos THEN 'neu' ELSE 'pos' END AS sentiment_label,
  count(*) AS n FROM comments GROUP BY 1, 2""", with_=f"WITH {COMMENTS}")
def label_counts(spark, sf):
    from moodloom.operators.classify import sentiment_columns as add

    return ag.label_counts(add(comments(spark, sf)), "sentiment_label", "event_type")


@query("tail_mass", """
SELECT cut, 100.0 * sum(CASE WHEN toxicity_score >= cut THEN w ELSE 0.0 END) / sum(w) AS pct
FROM (SELECT toxicity_score, pow(greatest(1.0 - toxicity_score, 0.0), 2.0) AS w, unnest([0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 0.97, 0.99]::DOUBLE[]) AS cut FROM comments) AS q
GROUP BY cut""", doubles="pct", with_=f"WITH {COMMENTS}")
def tail_mass(spark, sf):
    from moodloom.operators.classify import weight_of

    return ag.tail_mass(comments(spark, sf), "toxicity_score", weight_of(F.col("toxicity_score"), 2.0))


@query("histogram", """
SELECT event_type, CAST(least(floor((s + 1.0) * 79 / 2.0), 78) AS BIGINT) AS bin, count(*) AS n
FROM (SELECT event_type, (p_pos - p_neg) / (p_pos + p_neg + 1e-8) AS s FROM comments) AS q WHERE s BETWEEN -1 AND 1 GROUP BY 1, 2""",
       with_=f"WITH {COMMENTS}")
def histogram(spark, sf):
    from moodloom.operators.classify import sentiment_norm

    rows = comments(spark, sf).withColumn("s", sentiment_norm(F.col("p_pos"), F.col("p_neg")))
    return ag.histogram(rows, "s", by="event_type").withColumn("bin", F.col("bin").cast("bigint"))


@query("dist_stats", """
SELECT event_type, "column", count(v) AS n, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.25) AS q25,
  quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q75
FROM (SELECT event_type, 'sent_raw' AS "column", p_pos - p_neg AS v FROM comments
      UNION ALL SELECT event_type, 'toxicity_score', toxicity_score FROM comments) AS q GROUP BY 1, 2""",
       doubles="mean std q25 median q75", with_=f"WITH {COMMENTS}")
def dist_stats(spark, sf):
    rows = comments(spark, sf).withColumn("sent_raw", F.col("p_pos") - F.col("p_neg"))
    return ag.dist_stats(rows, ["sent_raw", "toxicity_score"], 0, "event_type")


@query("coverage_gap", """
SELECT o_orderkey, expected, collected, expected - collected AS gap
FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 50000.0) AS BIGINT) AS expected, coalesce(n, 0) AS collected FROM orders
      LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) AS l ON l_orderkey = o_orderkey) AS q
WHERE expected > collected""")
def coverage_gap(spark, sf):
    expected = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 50000.0).alias("total"))
    collected = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    gaps = ag.coverage_gap(expected, collected, "o_orderkey", "total")
    return gaps.select("o_orderkey", F.col("expected").cast("bigint"), "collected", F.col("gap").cast("bigint"))


@query("coverage_gap_top", """
SELECT o_orderkey, expected - collected AS gap
FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 50000.0) AS BIGINT) AS expected, coalesce(n, 0) AS collected FROM orders
      LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) AS l ON l_orderkey = o_orderkey) AS q
WHERE expected > collected ORDER BY gap DESC, o_orderkey LIMIT 50""")
def coverage_gap_top(spark, sf):
    expected = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 50000.0).alias("total"))
    collected = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return ag.coverage_gap(expected, collected, "o_orderkey", "total", 50).select("o_orderkey", F.col("gap").cast("bigint"))


@query("null_profile", """
SELECT "column", min(CASE WHEN v IS NOT NULL THEN date END) AS first_valid, count(*) - count(v) AS missing,
  count(*) FILTER (WHERE v IS NULL AND date > f) AS missing_after_start, count(*) FILTER (WHERE v IS NULL AND date > f) > 0 AS problem
FROM (SELECT *, min(CASE WHEN v IS NOT NULL THEN date END) OVER (PARTITION BY "column") AS f FROM (
  SELECT date, "column", v FROM daily UNPIVOT INCLUDE NULLS (v FOR "column" IN (COLUMNS(* EXCLUDE (date))))) AS l) AS q
GROUP BY "column" """, with_=f"WITH {DAILY}")
def null_profile(spark, sf):
    return ag.null_profile(daily(spark, sf), "date")


@query("monthly_mean", """
SELECT series, CAST(date_trunc('month', date) AS DATE) AS month, avg(x) AS x FROM gappy GROUP BY 1, 2""", doubles="x",
       with_=f"WITH {GAPPY}")
def monthly_mean(spark, sf):
    return ag.monthly_mean(gappy(spark, sf), "date", "x", "series")


@query("row_spread", """
SELECT date, row_min, row_max, row_max - row_min AS row_gap FROM (
  SELECT date, least(sub_index2, sub_index6, sub_index7) AS row_min, greatest(sub_index2, sub_index6, sub_index7) AS row_max
  FROM daily WHERE sub_index2 IS NOT NULL AND sub_index6 IS NOT NULL AND sub_index7 IS NOT NULL) AS q""",
       doubles="row_min row_max row_gap", with_=f"WITH {DAILY}")
def row_spread(spark, sf):
    return ag.row_spread(daily(spark, sf), ["sub_index2", "sub_index6", "sub_index7"]).select(
        "date", "row_min", "row_max", "row_gap")


@query("with_grid", """
SELECT comment_id, gamma, pow(greatest(1.0 - toxicity_score, 0.0), gamma) AS w
FROM (SELECT comment_id, toxicity_score, unnest([1.0, 2.0, 3.0]::DOUBLE[]) AS gamma FROM comments) AS q""", doubles="w",
       with_=f"WITH {COMMENTS}")
def with_grid(spark, sf):
    from moodloom.operators.classify import weight_of

    gridded = ag.with_grid(comments(spark, sf).select("comment_id", "toxicity_score"), [{"gamma": g} for g in (1.0, 2.0, 3.0)])
    return gridded.select("comment_id", "gamma", weight_of(F.col("toxicity_score"), F.col("gamma")).alias("w"))
