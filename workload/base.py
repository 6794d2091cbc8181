"""Registry of queries and the tables derived from the test data that several of them share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodloom.functions.columns import ratio
from moodloom.session import checkpoint_folder, ship_package
from moodloom.sources.tables import read_spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6, doubles: str = "", with_: str = "") -> Callable[[Query], Query]:
    """Register a query. Doubles are rounded on both sides; `doubles` names them for the SQL."""
    def register(run: Query) -> Query:
        def rounded(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            out = run(spark, sf)
            return out.withColumns({
                f"{c}": F.round(F.col(f"`{c}`"), digits) for c, t in out.dtypes if t == "double"}) if any(
                t == "double" for _, t in out.dtypes) else out

        QUERIES[name] = rounded
        if sql is not None:
            columns = doubles.split()
            swaps = ", ".join(f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in columns)
            body = f"SELECT * REPLACE ({swaps}) FROM (\n{sql.strip()}\n) AS q" if columns else sql.strip()
            ORACLES[name] = f"{with_.strip()}\n{body}" if with_ else body
        return rounded

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def text_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Texts, spread over the cores where the file has too few parts."""
    return read_spread(spark, os.path.join(sf, f"{name}.parquet"))


def scratch(spark: SparkSession, name: str) -> str:
    """New folder for written tables, in the folder all executors share."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- daily prices: one series per order priority -------------------------------------------------

PRICES = """
prices AS (
  SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 997.0 AS close,
         count(*) AS volume
  FROM orders GROUP BY 1, 2)"""

GAPPY = PRICES + """,
gappy AS (
  SELECT series, date, CASE WHEN day(date) % 6 = 0 OR (date < DATE '1995-01-20') THEN NULL ELSE close END AS x, close, volume
  FROM prices)"""


def exact_mean(column: str, scale: float) -> F.Column:
    """Mean of a money column from an exact decimal sum."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)) / scale


def prices(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date")).agg(
        exact_mean("o_totalprice", 997.0).alias("close"), F.count(F.lit(1)).alias("volume"))


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    missing = (F.day("date") % 6 == 0) | (F.col("date") < F.lit("1995-01-20").cast("date"))
    return prices(spark, sf).withColumn("x", F.when(~missing, F.col("close")))


# --- OHLCV-like panel: supplier x ship date -------------------------------------------------------

PANEL = """
panel AS (
  SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 997.0 AS close,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 997.0 AS value
  FROM lineitem GROUP BY 1, 2)"""


def panel(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    total = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    return rows.groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(
        (total / F.count(F.lit(1)) / 997.0).alias("close"), (total / 997.0).alias("value"))


# --- scored comments: events with probabilities and a weight --------------------------------------

COMMENTS = """
comments AS (
  SELECT event_id AS comment_id, user_id, ts AS comment_at, event_type,
         value / (value + 50.0) AS p_pos, 20.0 / (value + 50.0) AS p_neu, 30.0 / (value + 50.0) AS p_neg,
         CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN 'n/a' WHEN 'view' THEN '-0.5'
              WHEN 'signup' THEN '0.25' ELSE '0.75' END AS weight,
         CASE event_type WHEN 'error' THEN 1.0 WHEN 'click' THEN 0.9 ELSE 0.5 END
           * (value / (value + 9.0)) AS toxicity_score
  FROM events)"""


def comments(spark: SparkSession, sf: str) -> DataFrame:
    kind, v = F.col("event_type"), F.col("value")
    weight = F.when(kind == "error", F.lit(None).cast("string")).when(kind == "click", "n/a").when(
        kind == "view", "-0.5").when(kind == "signup", "0.25").otherwise("0.75")
    factor = F.when(kind == "error", 1.0).when(kind == "click", 0.9).otherwise(0.5)
    return table(spark, sf, "events").select(
        F.col("event_id").alias("comment_id"), "user_id", F.col("ts").alias("comment_at"), "event_type",
        (v / (v + 50.0)).alias("p_pos"), (20.0 / (v + 50.0)).alias("p_neu"), (30.0 / (v + 50.0)).alias("p_neg"),
        weight.alias("weight"), (factor * (v / (v + 9.0))).alias("toxicity_score"))


# --- merged daily table: prices, sub-indices and sentiment per date -------------------------------

DAILY = """
market AS (
  SELECT CAST(o_orderdate AS DATE) AS date,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 997.0 AS close,
         100.0 * avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS sub_index2,
         100.0 * avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END) AS sub_index3,
         100.0 * avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) AS sub_index4,
         100.0 * avg(CASE WHEN o_orderpriority = '5-LOW' THEN 1.0 ELSE 0.0 END) AS sub_index5
  FROM orders GROUP BY 1),
mood AS (
  SELECT CAST(l_shipdate AS DATE) AS date,
         100.0 * sum(CAST(l_quantity AS BIGINT)) / count(*) / 50.0 AS sub_index6,
         100.0 * avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS sub_index7,
         CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 17.0 - 0.8 AS sent_norm_w,
         CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 9.0 + 0.1 AS sent_strength_w,
         stddev_samp(l_discount) AS sent_std,
         (CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / count(*) - 0.04) * 31.0 AS neg_z,
         CAST(count(*) AS DOUBLE) AS effective_n,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) / 25.0 - 1.0 AS heat
  FROM lineitem GROUP BY 1),
daily AS (
  SELECT *, ln(close / lag(close) OVER (ORDER BY date)) AS log_return,
         ln(lead(close) OVER (ORDER BY date) / close) AS "log_return_t+1"
  FROM market LEFT JOIN mood USING (date))"""


def market(spark: SparkSession, sf: str) -> DataFrame:
    def share(condition):
        return 100.0 * F.avg(F.when(condition, 1.0).otherwise(0.0))

    return table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        exact_mean("o_totalprice", 997.0).alias("close"),
        share(F.col("o_orderstatus") == "F").alias("sub_index2"),
        share(F.col("o_orderstatus") == "O").alias("sub_index3"),
        share(F.col("o_orderpriority") == "1-URGENT").alias("sub_index4"),
        share(F.col("o_orderpriority") == "5-LOW").alias("sub_index5"))


def mood(spark: SparkSession, sf: str) -> DataFrame:
    def mean(column):
        return F.sum(F.col(column).cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))

    quantity = F.sum(F.col("l_quantity").cast("bigint")).cast("double") / F.count(F.lit(1))
    return table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(
        (100.0 * F.sum(F.col("l_quantity").cast("bigint")) / F.count(F.lit(1)) / 50.0).alias("sub_index6"),
        (100.0 * F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0))).alias("sub_index7"),
        (mean("l_discount") * 17.0 - 0.8).alias("sent_norm_w"), (mean("l_tax") * 9.0 + 0.1).alias("sent_strength_w"),
        F.stddev_samp("l_discount").alias("sent_std"), ((mean("l_tax") - 0.04) * 31.0).alias("neg_z"),
        F.count(F.lit(1)).cast("double").alias("effective_n"), (quantity / 25.0 - 1.0).alias("heat"))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """One market series over all orders. Partial aggregates shrink it to a row per date before any window."""
    from moodloom.operators.series import over_frames

    joined = market(spark, sf).join(mood(spark, sf), "date", "left")
    return over_frames(joined, lambda w: {
        "log_return": F.ln(ratio(F.col("close"), F.lag("close").over(w))),
        "log_return_t+1": F.ln(ratio(F.lead("close").over(w), F.col("close")))}, "date")


# --- strategy table: index, volatility state and trend per series ---------------------------------

STRATEGY = PRICES + """,
s1 AS (
  SELECT *, row_number() OVER w AS rn, coalesce(ln(close / lag(close) OVER w), 0.0) AS lr,
         ln(lead(close) OVER w / close) AS target_reg
  FROM prices WINDOW w AS (PARTITION BY series ORDER BY date)),
s2 AS (
  SELECT *,
    CASE WHEN rn > 60 THEN stddev_samp(lr) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS egarch_vol,
    list(close) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS past
  FROM s1),
s3 AS (
  SELECT *,
    CASE WHEN lag(egarch_vol) OVER w IS NOT NULL THEN least(greatest(egarch_vol / lag(egarch_vol) OVER w - 1, -5.0), 5.0) END AS vol_shock,
    CASE WHEN count(egarch_vol) OVER w60 = 60 AND egarch_vol > quantile_cont(egarch_vol, 0.7) OVER w60 THEN 1.0 ELSE 0.0 END::DOUBLE AS vol_regime_high,
    CASE WHEN rn >= 20 AND close > avg(close) OVER w20 THEN 1.0 ELSE 0.0 END
    + CASE WHEN rn >= 60 AND close > avg(close) OVER w60 THEN 1.0 ELSE 0.0 END
    + CASE WHEN rn >= 120 AND close > avg(close) OVER w120 THEN 1.0 ELSE 0.0 END::DOUBLE AS trend_strength,
    CASE WHEN len(past) >= 60 THEN 100.0 * len(list_filter(past, lambda v: v <= close)) / len(past) END AS index_score
  FROM s2
  WINDOW w AS (PARTITION BY series ORDER BY date),
         w20 AS (PARTITION BY series ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
         w60 AS (PARTITION BY series ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW),
         w120 AS (PARTITION BY series ORDER BY date ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)),
strat AS (
  SELECT series, date, close, egarch_vol, vol_shock, vol_regime_high, trend_strength, index_score, target_reg,
    CASE WHEN index_score > 65 AND vol_regime_high = 0 AND trend_strength >= 2 THEN 'bull'
         WHEN index_score < 25 OR coalesce(vol_shock > 2.0, false) THEN 'crisis' ELSE 'normal' END AS regime
  FROM s3 WHERE egarch_vol IS NOT NULL AND index_score IS NOT NULL AND target_reg IS NOT NULL)"""

# Shared tail of the strategy SQL: weights, lagged positions and net returns.
POSITIONS = STRATEGY + """,
p1 AS (
  SELECT *,
    CASE WHEN count(target_reg) OVER w3 = 3 THEN sum(target_reg) OVER w3 ELSE 0.0 END AS cumret_3d,
    CASE CAST(trend_strength AS INTEGER) WHEN 1 THEN 0.35 WHEN 2 THEN 0.7 WHEN 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS tw,
    least(greatest(sqrt((0.15 / sqrt(252.0)) / (egarch_vol + 1e-9)), 0.1), 2.0) AS vt,
    least(greatest(0.5 + index_score / 100.0 * 1.1, 0.5), 1.6) AS mult,
    CASE regime WHEN 'bull' THEN 1.2 WHEN 'normal' THEN 1.0 ELSE 0.7 END AS rw
  FROM strat WINDOW w3 AS (PARTITION BY series ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
p2 AS (
  SELECT *, CASE WHEN vol_shock > 2.0 OR cumret_3d < -0.07 THEN 0.0
                 ELSE least(greatest(tw * vt * mult * rw, 0.0), 3.0) END AS weight
  FROM p1),
p3 AS (
  SELECT *, coalesce(lag(weight, 1) OVER w, 0.0) AS weight_lag,
         abs(coalesce(lag(weight, 1) OVER w, 0.0) - coalesce(lag(weight, 2) OVER w, 0.0)) AS turnover
  FROM p2 WINDOW w AS (PARTITION BY series ORDER BY date)),
positions AS (SELECT *, weight_lag * target_reg - turnover * 0.00015 AS strat_ret FROM p3)"""


def metrics_sql(source: str, keys: str, ret: str = "strat_ret", ref: str = "target_reg", order: str = "date") -> str:
    """Performance figures in SQL over a named table."""
    return f"""
  SELECT {keys}, count({ret}) AS n, avg({ret}) * 252 AS ann_ret, stddev_samp({ret}) * sqrt(252.0) + 1e-9 AS ann_vol,
    min(fall) AS mdd, exp(sum({ret})) - 1 AS total_return,
    avg(CASE WHEN {ret} <= q THEN {ret} END) AS cvar5,
    stddev_samp(CASE WHEN {ref} < 0 THEN {ret} END) * sqrt(252.0) AS downside_vol,
    avg({ret}) * 252 / (stddev_samp({ret}) * sqrt(252.0) + 1e-9) AS sharpe,
    avg({ret}) * 252 / (abs(min(fall)) + 1e-9) AS calmar,
    avg(CASE WHEN {ref} < 0 THEN {ret} END) / (avg(CASE WHEN {ref} < 0 THEN {ref} END) + 1e-9) AS downday_defense
  FROM (
    SELECT *, grown / max(grown) OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS fall,
           quantile_cont({ret}, 0.05) OVER (PARTITION BY {keys}) AS q
    FROM (SELECT *, exp(sum({ret}) OVER (PARTITION BY {keys} ORDER BY {order})) AS grown FROM {source}) AS g1
  ) AS g2
  GROUP BY {keys}"""


METRIC_COLUMNS = "ann_ret ann_vol mdd total_return cvar5 downside_vol sharpe calmar downday_defense"


def strategy_table(spark: SparkSession, sf: str) -> DataFrame:
    from moodloom.operators.indicators import vol_features
    from moodloom.operators.models import log_returns, walk_forward_vol
    from moodloom.operators.risk import regime
    from moodloom.operators.series import over_frames
    from moodloom.operators.windows import rolled, rolling_percent_rank

    d = log_returns(prices(spark, sf), "close", "date", "series", "lr")
    d = vol_features(walk_forward_vol(d, "lr", by="series"), by="series")

    def parts(w):
        above = [F.coalesce(F.col("close") > rolled(F.avg, F.col("close"), w, n), F.lit(False)).cast("double")
                 for n in (20, 60, 120)]
        return {"trend_strength": above[0] + above[1] + above[2],
                "target_reg": F.ln(ratio(F.lead("close").over(w), F.col("close")))}

    d = rolling_percent_rank(d, "close", 252, 60, by="series", name="index_score")
    d = over_frames(d, parts, "date", "series", 119, 1).select(
        "series", "date", "close", "egarch_vol", "vol_shock", "vol_regime_high", "trend_strength", "index_score",
        "target_reg")
    return regime(d.dropna(subset=["egarch_vol", "index_score", "target_reg"]))
