"""Queries for market indicators: scores, sub-indices, rates, the merged table and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodloom.operators import indicators as ind
from moodloom.sources import tables as tb

from .base import DAILY, PANEL, PRICES, STRATEGY, daily, market, mood, panel, prices, query, strategy_table, table
from .series_queries import cdf_sql

BY = {"by": "series"}


def rank_sql(value: str, n: int, mp: int, source: str, keys: str, extra: str = "") -> str:
    """Rolling percent rank of a column in SQL; keys is '' or a PARTITION BY."""
    return f"""
  SELECT *, CASE WHEN len(known) >= {mp} THEN 100.0 * len(list_filter(known, lambda v: v <= known[-1])) / len(known) END AS score{extra}
  FROM (SELECT *, list_filter(list({value}) OVER ({keys} ORDER BY date ROWS {n - 1} PRECEDING), lambda v: v IS NOT NULL) AS known FROM {source}) AS k"""


@query("greed_score", f"""
SELECT series, date, r.score AS score_fear, c.score AS score_cdf FROM (
  {rank_sql('-close', 252, 100, 'prices', 'PARTITION BY series')}) AS r
JOIN (SELECT series, date, 100.0 * ({cdf_sql('z')}) AS score FROM (
  SELECT series, date, CASE WHEN count(close) OVER f >= 100 THEN
    least(greatest((close - avg(close) OVER f) / nullif(stddev_samp(close) OVER f, 0), -5.0), 5.0) END AS z
  FROM prices WINDOW f AS (PARTITION BY series ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) AS zz) AS c USING (series, date)
WHERE c.score IS NOT NULL OR r.score IS NOT NULL""", doubles="score_fear score_cdf", with_=f"WITH {PRICES}")
def greed_score(spark, sf):
    d = ind.to_greed_score(prices(spark, sf), "close", "fear", 252, 100, name="score_fear", **BY)
    d = ind.to_greed_score(d, "close", "greed", 252, 100, "z_cdf", name="score_cdf", keep_warmup=False, **BY)
    return d.select("series", "date", "score_fear", "score_cdf")


@query("idx_momentum", f"""
SELECT series, date, close, ma125, momentum_raw, score AS "Momentum_Score" FROM (
  {rank_sql('momentum_raw', 252, 60, 'raw', 'PARTITION BY series')}) AS q WHERE score IS NOT NULL""",
       doubles="close ma125 momentum_raw Momentum_Score", with_=f"""WITH {PRICES},
raw AS (SELECT *, close / ma125 - 1.0 AS momentum_raw FROM (
  SELECT series, date, close, CASE WHEN count(close) OVER w = 125 THEN avg(close) OVER w END AS ma125
  FROM prices WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 124 PRECEDING AND CURRENT ROW)) AS m)""")
def idx_momentum(spark, sf):
    return ind.idx_momentum(prices(spark, sf), min_periods=60, **BY)


@query("idx_strength", f"""
SELECT date, new_high, new_low, active_count, strength_raw, score AS "Strength_Score" FROM (
  {rank_sql('strength_raw', 252, 60, 'raw', '')}) AS q WHERE score IS NOT NULL""",
       doubles="strength_raw Strength_Score", with_=f"""WITH {PANEL},
marked AS (
  SELECT date, close, max(close) OVER w AS hi, min(close) OVER w AS lo, count(close) OVER w AS n
  FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
raw AS (
  SELECT *, 100.0 * (new_high - new_low) / nullif(active_count, 0) AS strength_raw FROM (
    SELECT date, count(*) FILTER (WHERE n >= 40 AND close >= hi) AS new_high, count(*) FILTER (WHERE n >= 40 AND close <= lo) AS new_low,
      count(*) FILTER (WHERE n >= 40) AS active_count FROM marked GROUP BY date) AS d)""")
def idx_strength(spark, sf):
    return ind.idx_strength(panel(spark, sf), min_obs=40, min_periods=60)


BREADTH = PANEL + """,
moved AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM panel),
net AS (
  SELECT *, av - dv AS net_value, row_number() OVER (ORDER BY date) AS rn FROM (
    SELECT date, sum(CASE WHEN close > prev THEN value ELSE 0.0 END) AS av, sum(CASE WHEN close < prev THEN value ELSE 0.0 END) AS dv
    FROM moved GROUP BY date) AS d),
smooth AS (
  SELECT date, rn, net_value AS fast, net_value AS slow, av, dv, net_value FROM net WHERE rn = 1
  UNION ALL
  SELECT n.date, n.rn, 0.9::DOUBLE * s.fast + 0.1::DOUBLE * n.net_value, 0.95::DOUBLE * s.slow + 0.05::DOUBLE * n.net_value, n.av, n.dv, n.net_value
  FROM smooth AS s JOIN net AS n ON n.rn = s.rn + 1),
osc AS (SELECT *, fast - slow AS oscillator FROM smooth)"""


@query("idx_breadth", f"""
SELECT date, av AS "AV", dv AS "DV", net_value, fast AS trend_fast, slow AS trend_slow, oscillator, 100.0 * ({cdf_sql('z')}) AS osc_score_0_100
FROM (SELECT *, CASE WHEN count(oscillator) OVER f >= 60 THEN
    least(greatest((oscillator - avg(oscillator) OVER f) / nullif(stddev_samp(oscillator) OVER f, 0), -5.0), 5.0) END AS z
  FROM osc WINDOW f AS (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) AS q WHERE z IS NOT NULL""",
       doubles="AV DV net_value trend_fast trend_slow oscillator osc_score_0_100", with_="WITH RECURSIVE " + BREADTH, digits=5)
def idx_breadth(spark, sf):
    return ind.idx_breadth(panel(spark, sf), min_periods=60)


@query("idx_putcall", f"""
SELECT date, put_call_ratio, score AS score_pcr FROM (
  {rank_sql('-put_call_ratio', 252, 60, 'raw', '')}) AS q WHERE score IS NOT NULL""",
       doubles="put_call_ratio score_pcr", with_="""WITH raw AS (
  SELECT date, put::DOUBLE / nullif(call, 0) AS put_call_ratio FROM (
    SELECT CAST(o_orderdate AS DATE) AS date, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS put,
      count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS call FROM orders GROUP BY 1) AS d)""")
def idx_putcall(spark, sf):
    d = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("put"),
        F.count_if(F.col("o_orderpriority") == "5-LOW").alias("call"))
    return ind.idx_putcall(d, "put", "call", min_periods=60)


@query("idx_volatility", f"""
SELECT series, date, close AS volatility, vol_ma, vol_ratio, score AS "Score_Fear" FROM (
  {rank_sql('-vol_ratio', 252, 60, 'raw', 'PARTITION BY series')}) AS q WHERE score IS NOT NULL""",
       doubles="volatility vol_ma vol_ratio Score_Fear", with_=f"""WITH {PRICES},
raw AS (SELECT *, close / vol_ma AS vol_ratio FROM (
  SELECT series, date, close, CASE WHEN count(close) OVER w = 50 THEN avg(close) OVER w END AS vol_ma
  FROM prices WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) AS m)""")
def idx_volatility(spark, sf):
    return ind.idx_volatility(prices(spark, sf), "close", min_periods=60, **BY)


@query("idx_safe", f"""
SELECT date, stock_ret_20d, bond_ret_20d, safe_demand_raw, score AS score_safe_demand FROM (
  {rank_sql('-safe_demand_raw', 252, 60, 'raw', '')}) AS q WHERE score IS NOT NULL""",
       doubles="stock_ret_20d bond_ret_20d safe_demand_raw score_safe_demand", with_=f"""WITH {DAILY},
raw AS (SELECT *, bond_ret_20d - stock_ret_20d AS safe_demand_raw FROM (
  SELECT date, close / lag(close, 20) OVER w - 1.0 AS stock_ret_20d, sub_index6 / lag(sub_index6, 20) OVER w - 1.0 AS bond_ret_20d
  FROM daily WINDOW w AS (ORDER BY date)) AS r)""")
def idx_safe(spark, sf):
    d = market(spark, sf).join(mood(spark, sf), "date", "left")
    return ind.idx_safe(d, "close", "sub_index6", min_periods=60)


RATES = """
rates AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'N') AS DOUBLE) / count(*) FILTER (WHERE l_returnflag = 'N') / 997.0 AS "GOV3Y",
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / count(*) FILTER (WHERE l_returnflag = 'R') / 997.0 AS "BBB",
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) / count(*) FILTER (WHERE l_returnflag = 'A') / 997.0 AS "AA"
  FROM lineitem GROUP BY 1)"""


def wide_rates(spark, sf):
    """Items as rows and months as columns, as the rate source has them."""
    total = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    long = table(spark, sf, "lineitem").groupBy("l_returnflag", F.date_format("l_shipdate", "yyyy/MM").alias("month")).agg(
        (total / F.count(F.lit(1)) / 997.0).alias("rate"))
    wide = long.groupBy("l_returnflag").pivot("month").agg(F.first("rate"))
    months = [c for c in wide.columns if c != "l_returnflag"]
    return wide.select(F.col("l_returnflag").alias("item"), F.lit("x").alias("unit"), F.lit("y").alias("kind"),
                       F.lit("z").alias("note"), *[F.col(f"`{m}`") for m in months])


ITEMS = {"N": "GOV3Y", "R": "BBB", "A": "AA"}


@query("rates_unpivot", 'SELECT date, "GOV3Y", "BBB", "AA" FROM rates', doubles="GOV3Y BBB AA", with_=f"WITH {RATES}")
def rates_unpivot(spark, sf):
    return tb.load_rate_table(wide_rates(spark, sf), "item", ITEMS)


@query("idx_spread", f"""
SELECT date, "GOV3Y", "BBB", "AA", junk_spread, score AS "Final_JunkIndex" FROM (
  {rank_sql('-junk_spread', 12, 12, 'raw', '')}) AS q WHERE score IS NOT NULL""",
       doubles="GOV3Y BBB AA junk_spread Final_JunkIndex", with_=f"""WITH {RATES},
raw AS (SELECT *, "BBB" - "GOV3Y" AS junk_spread FROM rates)""")
def idx_spread(spark, sf):
    return ind.idx_spread(tb.load_rate_table(wide_rates(spark, sf), "item", ITEMS))


MERGED = [f"sub_index{i}" for i in range(2, 8)]
MOODS = ["sent_norm_w", "sent_strength_w", "sent_std", "neg_z", "effective_n", "heat"]


@query("merge_daily", f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (ORDER BY date) AS rn FROM (
    SELECT m.date, m.close, log_return, coalesce(p.patched, s.sub_index2) AS sub_index2, {', '.join(f's.{c}' for c in MERGED[1:4])},
      {', '.join(f'd.{c}' for c in MERGED[4:] + MOODS)}, lead(log_return) OVER (ORDER BY m.date) AS "log_return_t+1"
    FROM (SELECT date, close, ln(close / lag(close) OVER (ORDER BY date)) AS log_return FROM market) AS m
    LEFT JOIN (SELECT * REPLACE (CASE WHEN date <> DATE '1995-03-01' THEN sub_index2 END AS sub_index2) FROM market) AS s USING (date)
    LEFT JOIN (SELECT DATE '1995-03-01' AS date, 26.25 AS patched) AS p USING (date)
    LEFT JOIN mood AS d USING (date)
    WHERE log_return IS NOT NULL) AS a
  WHERE "log_return_t+1" IS NOT NULL) AS q WHERE rn > 37""",
       doubles=" ".join(["close", "log_return", *MERGED, *MOODS, "log_return_t+1"]), with_=f"WITH {DAILY}")
def merge_daily(spark, sf):
    m, s = market(spark, sf), mood(spark, sf)
    gap = F.col("date") == F.lit("1995-03-01").cast("date")
    patch = m.where(gap).select("date", F.lit(26.25).alias("sub_index2")).distinct()
    indices = [m.where(~gap).select("date", MERGED[0]), *[m.select("date", c) for c in MERGED[1:4]], *[s.select("date", c) for c in MERGED[4:]]]
    merged = ind.merge_daily(m.select("date", "close"), indices, s.select("date", *MOODS), patch, skip=37)
    return merged.select("date", "close", "log_return", *MERGED, *MOODS, "log_return_t+1")


RSI = PRICES + """,
gl AS (SELECT series, date, row_number() OVER w AS rn, greatest(close - lag(close) OVER w, 0.0) AS gain0, greatest(lag(close) OVER w - close, 0.0) AS loss0,
         lag(close) OVER w AS prev FROM prices WINDOW w AS (PARTITION BY series ORDER BY date)),
sm AS (
  SELECT series, date, rn, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS l FROM gl WHERE rn = 1
  UNION ALL
  SELECT n.series, n.date, n.rn, CASE WHEN s.g IS NULL THEN n.gain0 ELSE (1 - 1 / 14::DOUBLE) * s.g + n.gain0 / 14::DOUBLE END,
    CASE WHEN s.l IS NULL THEN n.loss0 ELSE (1 - 1 / 14::DOUBLE) * s.l + n.loss0 / 14::DOUBLE END
  FROM sm AS s JOIN gl AS n ON n.series = s.series AND n.rn = s.rn + 1)"""


@query("rsi", "SELECT series, date, 100 - 100 / (1 + g / (l + 1e-9)) AS rsi14 FROM sm", doubles="rsi14",
       with_="WITH RECURSIVE " + RSI)
def rsi(spark, sf):
    return ind.rsi(prices(spark, sf), "close", **BY).select("series", "date", "rsi14")


@query("vol_features", """
SELECT series, date, egarch_vol, CASE WHEN egarch_vol IS NOT NULL THEN vol_shock END AS vol_shock, vol_regime_high,
  CASE WHEN count(egarch_vol) OVER w5 = 5 THEN avg(egarch_vol) OVER w5 END AS vol_ma5,
  CASE WHEN count(egarch_vol) OVER w5 = 5 AND egarch_vol > avg(egarch_vol) OVER w5 THEN 1.0 ELSE 0.0 END::DOUBLE AS vol_trend
FROM s3 WINDOW w5 AS (PARTITION BY series ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
       doubles="egarch_vol vol_shock vol_regime_high vol_ma5 vol_trend", with_=f"WITH {STRATEGY}", digits=8)
def vol_features(spark, sf):
    from moodloom.operators.models import log_returns, walk_forward_vol

    d = walk_forward_vol(log_returns(prices(spark, sf), "close", "date", "series", "lr"), "lr", by="series")
    return ind.vol_features(d, **BY).select("series", "date", "egarch_vol", "vol_shock", "vol_regime_high", "vol_ma5", "vol_trend")


@query("walk_forward_vol", "SELECT series, date, egarch_vol FROM s2", doubles="egarch_vol", with_=f"WITH {STRATEGY}", digits=8)
def walk_forward_vol(spark, sf):
    from moodloom.operators.models import log_returns, walk_forward_vol as estimate

    d = log_returns(prices(spark, sf), "close", "date", "series", "lr")
    return estimate(d, "lr", by="series").select("series", "date", "egarch_vol")


@query("state_bucket", """
SELECT series, date, CASE WHEN index_score < 25 THEN '극단적 공포' WHEN index_score < 45 THEN '공포' WHEN index_score < 55 THEN '중립'
  WHEN index_score < 75 THEN '탐욕' ELSE '극단적 탐욕' END AS state,
  CASE WHEN index_score < 25 THEN '#1684fc' WHEN index_score < 45 THEN '#21a8d8' WHEN index_score < 65 THEN '#2fb47c'
  WHEN index_score < 75 THEN '#ff9f1c' ELSE '#ff3b30' END AS colour FROM strat""", with_=f"WITH {STRATEGY}")
def state_bucket(spark, sf):
    return ind.state_bucket(strategy_table(spark, sf), "index_score", "state", "colour").select("series", "date", "state", "colour")


FEATURES = DAILY + """,
f0 AS (
  SELECT *, row_number() OVER w AS rn, coalesce(log_return, 0.0) AS lr0,
    last_value(sent_norm_w IGNORE NULLS) OVER w AS sn, last_value(sent_strength_w IGNORE NULLS) OVER w AS ss,
    last_value(sent_std IGNORE NULLS) OVER w AS sd, last_value(neg_z IGNORE NULLS) OVER w AS nz,
    last_value(effective_n IGNORE NULLS) OVER w AS en, last_value(heat IGNORE NULLS) OVER w AS ht
  FROM daily WINDOW w AS (ORDER BY date)),
f1 AS (
  SELECT *, CASE WHEN rn > 60 THEN stddev_samp(lr0) OVER (ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS vol,
    sn * 0.4 + (-nz) * 0.3 + (ss * sn) * 0.3 AS comp,
    close - lag(close) OVER (ORDER BY date) AS delta FROM f0),
r0 AS (
  SELECT date, rn, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS l FROM f1 WHERE rn = 1
  UNION ALL
  SELECT n.date, n.rn, CASE WHEN s.g IS NULL THEN greatest(n.delta, 0.0) ELSE (1 - 1 / 14::DOUBLE) * s.g + greatest(n.delta, 0.0) / 14::DOUBLE END,
    CASE WHEN s.l IS NULL THEN greatest(-n.delta, 0.0) ELSE (1 - 1 / 14::DOUBLE) * s.l + greatest(-n.delta, 0.0) / 14::DOUBLE END
  FROM r0 AS s JOIN f1 AS n ON n.rn = s.rn + 1),
f2 AS (
  SELECT f1.*, least(greatest(vol / lag(vol) OVER w - 1, -5.0), 5.0) AS shock,
    CASE WHEN count(vol) OVER w60 = 60 AND vol > quantile_cont(vol, 0.7) OVER w60 THEN 1.0 ELSE 0.0 END AS high,
    CASE WHEN count(vol) OVER w5 = 5 THEN avg(vol) OVER w5 END AS vma5,
    CASE WHEN count(vol) OVER w60 = 60 THEN vol / (avg(vol) OVER w60 + 1e-9) END AS vratio,
    CASE WHEN f1.rn >= 20 THEN avg(close) OVER w20 END AS m20, CASE WHEN f1.rn >= 60 THEN avg(close) OVER w60 END AS m60,
    CASE WHEN f1.rn >= 120 THEN avg(close) OVER w120 END AS m120, CASE WHEN f1.rn >= 5 THEN avg(close) OVER w5 END AS m5,
    CASE WHEN count(sn) OVER w5 = 5 THEN avg(sn) OVER w5 END AS snma5, CASE WHEN count(nz) OVER w5 = 5 THEN avg(nz) OVER w5 END AS nzma5,
    CASE WHEN count(comp) OVER w10 = 10 THEN avg(comp) OVER w10 END AS compma,
    comp - lag(comp, 5) OVER w AS compdiff, sn - lag(sn) OVER w AS sndiff,
    close / lag(close, 5) OVER w - 1 AS mom5, close / lag(close, 20) OVER w - 1 AS mom20, close / lag(close, 60) OVER w - 1 AS mom60,
    sub_index6 AS si6, lag(sub_index6) OVER w AS si6lag, lag(vol) OVER w AS vlag,
    100 - 100 / (1 + g / (l + 1e-9)) AS rsi,
    CASE WHEN count("log_return_t+1") OVER n5 = 5 THEN sum("log_return_t+1") OVER n5 END AS target5
  FROM f1 JOIN r0 USING (date)
  WINDOW w AS (ORDER BY date), w5 AS (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
    w10 AS (ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), w20 AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
    w60 AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), w120 AS (ORDER BY date ROWS BETWEEN 119 PRECEDING AND CURRENT ROW),
    n5 AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
f3 AS (SELECT *, least(greatest((-nz) / (vlag + 1e-6), -10.0), 10.0) AS nzv, lag(vma5) OVER w AS vma5lag, lag(shock) OVER w AS shocklag,
         lag(sub_index2) OVER w AS si2lag, lag(sub_index7) OVER w AS si7lag, CASE WHEN close > m20 THEN 1.0 ELSE 0.0 END + CASE WHEN close > m60 THEN 1.0 ELSE 0.0 END
         + CASE WHEN close > m120 THEN 1.0 ELSE 0.0 END AS trend FROM f2 WINDOW w AS (ORDER BY date)),
feats AS (
  SELECT date, "log_return_t+1" AS target_reg, target5 AS target_5d, lag(close) OVER w AS close, lag(sn) OVER w AS sent_norm_w,
    lag(-sd) OVER w AS sent_std_inv, lag(ss * sn) OVER w AS sent_energy, lag(comp) OVER w AS sent_composite, lag(compma) OVER w AS sent_composite_ma10,
    lag(compdiff) OVER w AS sent_composite_diff, lag(snma5) OVER w AS sent_norm_ma5, lag(nzma5) OVER w AS neg_z_ma5, lag(sndiff) OVER w AS sent_norm_diff,
    lag(m5 / (m20 + 1e-9) - 1) OVER w AS ma_ratio_5_20, lag(m20 / (m60 + 1e-9) - 1) OVER w AS ma_ratio_20_60, lag(m60 / (m120 + 1e-9) - 1) OVER w AS ma_ratio_60_120,
    lag(rsi) OVER w AS rsi14, lag(mom5) OVER w AS mom5, lag(mom20) OVER w AS mom20, lag(mom60) OVER w AS mom60, CAST(lag(trend) OVER w AS DOUBLE) AS trend_strength,
    lag(vratio) OVER w AS vol_ratio, lag(vol) OVER w AS egarch_vol, lag(shock) OVER w AS vol_shock, CAST(lag(high) OVER w AS DOUBLE) AS vol_regime_high,
    lag(si6lag) OVER w AS sub_index6_lag1, lag(si2lag) OVER w AS sub_index2_lag1, lag(nzv) OVER w AS neg_z_vol_ratio,
    CAST(lag(isodow(date) - 1) OVER w AS DOUBLE) AS dayofweek, CAST(lag(month(date)) OVER w AS DOUBLE) AS month,
    lag(shocklag) OVER w AS s1, lag(vma5lag) OVER w AS s2, lag(si6) OVER w AS s3, lag(si7lag) OVER w AS s4, lag(sub_index7) OVER w AS s5, lag("log_return_t+1") OVER w AS s6, lag(log_return) OVER w AS s7
  FROM f3 WINDOW w AS (ORDER BY date))"""
FEATURE_COLUMNS = ("target_reg target_5d close sent_norm_w sent_std_inv sent_energy sent_composite sent_composite_ma10 sent_composite_diff "
                   "sent_norm_ma5 neg_z_ma5 sent_norm_diff ma_ratio_5_20 ma_ratio_20_60 ma_ratio_60_120 rsi14 mom5 mom20 mom60 trend_strength "
                   "vol_ratio egarch_vol vol_shock vol_regime_high sub_index6_lag1 sub_index2_lag1 neg_z_vol_ratio dayofweek month")


def features(spark, sf):
    from moodloom.plans.strategy import prepare

    return prepare(daily(spark, sf))


@query("build_features", f"""
SELECT date, {', '.join(FEATURE_COLUMNS.split())} FROM feats
WHERE COLUMNS(*) IS NOT NULL""", doubles=FEATURE_COLUMNS, with_="WITH RECURSIVE " + FEATURES)
def build_features(spark, sf):
    return features(spark, sf).select("date", *FEATURE_COLUMNS.split())
