"""Queries for regimes, exposure, performance, tests of significance, models and account figures."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moodloom.functions import fixed_values as fv
from moodloom.operators import inference as inf
from moodloom.operators import models as md
from moodloom.operators import ranks as rk
from moodloom.operators import risk as rs
from moodloom.operators.series import Spans
from moodloom.plans import strategy as plan
from moodloom.session import settle

from .base import DAILY, METRIC_COLUMNS, POSITIONS, PRICES, STRATEGY, daily, metrics_sql, prices, query, strategy_table
from .market_queries import features

BY = {"by": "series"}


def positions(spark, sf):
    return rs.default_strategy(strategy_table(spark, sf), ["series"])


@query("regime", "SELECT series, date, regime FROM strat", with_=f"WITH {STRATEGY}")
def regime(spark, sf):
    return strategy_table(spark, sf).select("series", "date", "regime")


@query("exposure", "SELECT series, date, cumret_3d, weight FROM positions", doubles="cumret_3d weight", with_=f"WITH {POSITIONS}")
def exposure(spark, sf):
    return rs.exposure(strategy_table(spark, sf), **BY).select("series", "date", "cumret_3d", "weight")


@query("exposure_contrarian", """
SELECT series, date, CASE WHEN vol_shock > 2.0 OR cumret_3d < -0.07 THEN 0.0
  ELSE least(greatest(tw * vt * least(greatest(1.6 - index_score / 100.0 * 1.1, 0.5), 1.6) * rw, 0.0), 3.0) END AS weight FROM p1""",
       doubles="weight", with_=f"WITH {POSITIONS}")
def exposure_contrarian(spark, sf):
    return rs.exposure(strategy_table(spark, sf), momentum=False, **BY).select("series", "date", "weight")


@query("strategy_return", "SELECT series, date, weight_lag, turnover, strat_ret FROM positions",
       doubles="weight_lag turnover strat_ret", with_=f"WITH {POSITIONS}")
def strategy_return(spark, sf):
    return positions(spark, sf).select("series", "date", "weight_lag", "turnover", "strat_ret")


BENCH = POSITIONS + """,
b0 AS (SELECT series, date, target_reg, tw AS w1, CASE WHEN vol_shock > 2.0 THEN 0.0 ELSE least(greatest(tw * vt, 0.0), 2.0) END AS w2 FROM p1),
bench AS (
  SELECT series, date, target_reg AS hold,
    coalesce(lag(w1) OVER w, 0.0) * target_reg - abs(coalesce(lag(w1) OVER w, 0.0) - coalesce(lag(w1, 2) OVER w, 0.0)) * 0.00015 AS trend,
    coalesce(lag(w2) OVER w, 0.0) * target_reg - abs(coalesce(lag(w2) OVER w, 0.0) - coalesce(lag(w2, 2) OVER w, 0.0)) * 0.00015 AS trend_vol
  FROM b0 WINDOW w AS (PARTITION BY series ORDER BY date))"""


def bench(spark, sf):
    base = strategy_table(spark, sf)
    parts = [rs.bench_returns(base, kind, **BY).select("series", "date", F.col("strat_ret").alias(kind))
             for kind in ("hold", "trend", "trend_vol")]
    return parts[0].join(parts[1], ["series", "date"]).join(parts[2], ["series", "date"])


@query("bench_returns", "SELECT * FROM bench", doubles="hold trend trend_vol", with_=f"WITH {BENCH}")
def bench_returns(spark, sf):
    return bench(spark, sf)


@query("perf_metrics", metrics_sql("positions", "series"), doubles=METRIC_COLUMNS, with_=f"WITH {POSITIONS}")
def perf_metrics(spark, sf):
    return rs.perf_metrics(positions(spark, sf), **BY)


@query("perf_metrics_spans", metrics_sql("positions", "series"), doubles=METRIC_COLUMNS, with_=f"WITH {POSITIONS}")
def perf_metrics_spans(spark, sf):
    return rs.perf_metrics(positions(spark, sf), spans=Spans("date_trunc('month', date)"), **BY)


@query("compare_with_market", f"""
SELECT s.series, s.sharpe, s.mdd, h.sharpe AS base_sharpe, h.mdd AS base_mdd
FROM ({metrics_sql('positions', 'series')}) AS s JOIN ({metrics_sql('bench2', 'series')}) AS h USING (series)""",
       doubles="sharpe mdd base_sharpe base_mdd", with_=f"WITH {POSITIONS}, bench2 AS (SELECT series, date, target_reg AS strat_ret, target_reg FROM strat)")
def compare_with_market(spark, sf):
    base = strategy_table(spark, sf)
    held = rs.perf_metrics(rs.bench_returns(base, "hold"), **BY)
    mine = rs.perf_metrics(rs.default_strategy(base, ["series"]), **BY)
    return rs.compare_with_market(mine, held, ["series"]).select("series", "sharpe", "mdd", "base_sharpe", "base_mdd")


@query("fee_stress", metrics_sql("priced", "series, fee"), doubles=METRIC_COLUMNS + " fee", with_=f"""WITH {POSITIONS},
priced AS (SELECT series, date, target_reg, fee, weight_lag * target_reg - turnover * fee AS strat_ret
  FROM (SELECT *, unnest([0.00015, 0.0003, 0.00045]::DOUBLE[]) AS fee FROM p3) AS f)""")
def fee_stress(spark, sf):
    sized = rs.exposure(strategy_table(spark, sf), **BY).select("series", "date", "target_reg", "weight")
    return rs.fee_stress(sized, **BY)


YEARLY = POSITIONS.replace(
    "SELECT series, date, close, egarch_vol, vol_shock", "SELECT series AS s, year(date) AS year, series || '/' || year(date) AS series, date, close, egarch_vol, vol_shock"
).replace("positions AS (SELECT *, weight_lag", "positions AS (SELECT *, count(*) OVER (PARTITION BY series) AS year_rows, weight_lag") + """,
full_years AS (SELECT s, year, date, target_reg, strat_ret FROM positions WHERE year_rows >= 50)"""


@query("perf_by_year", f'SELECT s AS series, * EXCLUDE (s) FROM ({metrics_sql("full_years", "s, year")}) AS m', doubles=METRIC_COLUMNS,
       with_=f"WITH {YEARLY}")
def perf_by_year(spark, sf):
    return rs.perf_by_year(strategy_table(spark, sf), **BY).withColumn("year", F.col("year").cast("bigint"))


@query("perf_oos", f"""
SELECT m.s AS series, m.* EXCLUDE (s), CAST(y.train_years AS BIGINT) AS train_years FROM ({metrics_sql("full_years", "s, year")}) AS m
JOIN (SELECT s, year, row_number() OVER (PARTITION BY s ORDER BY year) - 1 AS train_years FROM (SELECT DISTINCT s, year FROM strat) AS d) AS y
  ON m.s = y.s AND m.year = y.year WHERE y.train_years >= 2""", doubles=METRIC_COLUMNS, with_=f"WITH {YEARLY}")
def perf_oos(spark, sf):
    return rs.perf_oos(strategy_table(spark, sf), **BY).withColumns({
        "year": F.col("year").cast("bigint"), "train_years": F.col("train_years").cast("bigint")})


ACCOUNT = BENCH + """,
wide AS (SELECT series, b.date, b.hold, b.trend, p.strat_ret AS main FROM bench AS b JOIN positions AS p USING (series, date)),
longer AS (SELECT series, date, 'hold' AS strategy, hold / 10.0 AS r FROM wide UNION ALL SELECT series, date, 'trend', trend / 10.0 FROM wide UNION ALL SELECT series, date, 'main', main / 10.0 FROM wide),
n0 AS (SELECT *, row_number() OVER (PARTITION BY series, strategy ORDER BY date) AS rn FROM longer),
acc AS (
  SELECT series, strategy, date, rn, r, 1000.0::DOUBLE * exp(r) AS nav, 1000.0::DOUBLE AS contributed FROM n0 WHERE rn = 1
  UNION ALL
  SELECT n.series, n.strategy, n.date, n.rn, n.r,
    (a.nav + CASE WHEN date_trunc('month', n.date) <> date_trunc('month', a.date) THEN 100.0::DOUBLE ELSE 0.0 END) * exp(n.r),
    a.contributed + CASE WHEN date_trunc('month', n.date) <> date_trunc('month', a.date) THEN 100.0::DOUBLE ELSE 0.0 END
  FROM acc AS a JOIN n0 AS n ON n.series = a.series AND n.strategy = a.strategy AND n.rn = a.rn + 1),
stats AS (
  SELECT series, strategy, arg_max(nav, date) AS final_value, arg_max(contributed, date) AS contributed, count(r) AS n,
    stddev_pop(r) * sqrt(252.0) AS ann_vol, min(fall) AS mdd, exp(sum(r) / greatest(count(r) / 252.0, 1 / 252.0)) - 1 AS ann_ret
  FROM (SELECT *, nav / max(nav) OVER (PARTITION BY series, strategy ORDER BY date) - 1 AS fall FROM acc) AS f GROUP BY series, strategy)"""


@query("account_stats", """
SELECT *, final_value - contributed AS profit, final_value / contributed - 1 AS total_return, ann_ret / ann_vol AS sharpe,
  final_value - max(CASE WHEN strategy = 'hold' THEN final_value END) OVER (PARTITION BY series) AS delta_vs_baseline FROM stats""",
       doubles="final_value contributed ann_vol mdd profit total_return ann_ret sharpe delta_vs_baseline", digits=5,
       with_="WITH RECURSIVE " + ACCOUNT)
def account_stats(spark, sf):
    held = bench(spark, sf)
    wide = held.join(positions(spark, sf).select("series", "date", F.col("strat_ret").alias("main")), ["series", "date"])
    scaled = wide.select("series", "date", *[(F.col(c) / 10.0).alias(c) for c in ("hold", "trend", "main")])
    return rs.account_stats(scaled, ["hold", "trend", "main"], 1000.0, 100.0, baseline="hold", by="series")


# Two-sided p-value of Student's t by Simpson's rule over the angle; 4000 intervals.
def p_sql(t: str, dof: str) -> str:
    theta = f"atan(abs({t}) / sqrt({dof}))"
    h = f"((pi() / 2 - {theta}) / 4000)"
    return f"""(2.0 / exp(lgamma(0.5) + lgamma({dof} / 2.0) - lgamma(({dof} + 1) / 2.0)) * {h} / 3.0 *
  list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i = 0 OR i = 4000 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)::DOUBLE
    * pow(greatest(cos({theta} + i * {h}), 0.0), {dof} - 1))))"""


@query("ttest_1samp", f"""
SELECT series, a.n, a.mean, a.std, a.t_stat, {p_sql('a.t_stat', '(a.n - 1)')} AS p_value, b.n AS n_down, b.t_stat AS t_down
FROM (SELECT series, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS std, avg(x) / (stddev_samp(x) / sqrt(count(x))) AS t_stat FROM excess GROUP BY series) AS a
JOIN (SELECT series, count(x) AS n, avg(x) / (stddev_samp(x) / sqrt(count(x))) AS t_stat FROM excess WHERE target_reg < 0 GROUP BY series) AS b USING (series)""",
       doubles="mean std t_stat p_value t_down",
       with_=f"WITH {POSITIONS}, excess AS (SELECT series, target_reg, strat_ret - target_reg AS x FROM positions)")
def ttest_1samp(spark, sf):
    excess = positions(spark, sf).withColumn("x", F.col("strat_ret") - F.col("target_reg"))
    both = inf.ttests_1samp(excess, "x", {"": None, "_down": F.col("target_reg") < 0}, "series")
    return both.select("series", "n", "mean", "std", "t_stat", "p_value", "n_down", F.col("t_stat_down").alias("t_down"))


@query("ttest_welch", f"""
SELECT *, {p_sql('t_stat', 'dof')} AS p_value FROM (
  SELECT series, n_high, mean_high, n_low, mean_low, (mean_high - mean_low) / sqrt(v1 / n_high + v2 / n_low) AS t_stat,
    pow(v1 / n_high + v2 / n_low, 2) / (pow(v1 / n_high, 2) / (n_high - 1) + pow(v2 / n_low, 2) / (n_low - 1)) AS dof
  FROM (SELECT series, count(h) AS n_high, avg(h) AS mean_high, var_samp(h) AS v1, count(l) AS n_low, avg(l) AS mean_low, var_samp(l) AS v2
    FROM (SELECT series, CASE WHEN index_score >= hi THEN target_reg END AS h, CASE WHEN index_score <= lo THEN target_reg END AS l
      FROM (SELECT *, quantile_cont(index_score, 0.75) OVER (PARTITION BY series) AS hi, quantile_cont(index_score, 0.25) OVER (PARTITION BY series) AS lo FROM strat) AS q) AS p
    GROUP BY series) AS m) AS t""", doubles="mean_high mean_low t_stat dof p_value", with_=f"WITH {STRATEGY}")
def ttest_welch(spark, sf):
    return inf.ttest_welch(strategy_table(spark, sf), "target_reg", "index_score", by="series")


# The distribution function of Student's t as the finite sum it is for whole degrees of freedom.
@query("spearman", """
SELECT series, rho, n, rho > 0 AS momentum, 1 - CASE WHEN nu % 2 = 0
    THEN sin(th) * (1 + coalesce((SELECT sum(exp(c + 2 * j * ln(cos(th)))) FROM steps WHERE j <= nu / 2 - 1 AND even), 0))
    ELSE 2 / pi() * (th + sin(th) * cos(th) * (1 + coalesce((SELECT sum(exp(c + 2 * j * ln(cos(th)))) FROM steps WHERE j <= (nu - 3) / 2 AND NOT even), 0))) END AS p_value
FROM (SELECT *, atan(abs(rho) * sqrt(nu / (1 - rho * rho)) / sqrt(nu)) AS th FROM (SELECT *, n - 2 AS nu FROM rhos))""", doubles="rho p_value", with_=f"""WITH {STRATEGY},
rhos AS (
  SELECT series, corr(ra, rb) AS rho, count(*) AS n FROM (
    SELECT series, rank() OVER (PARTITION BY series ORDER BY index_score) + (count(*) OVER (PARTITION BY series, index_score) - 1) / 2.0 AS ra,
      rank() OVER (PARTITION BY series ORDER BY target_reg) + (count(*) OVER (PARTITION BY series, target_reg) - 1) / 2.0 AS rb FROM strat) AS q
  GROUP BY series),
steps AS (
  SELECT j, even, sum(ln(CASE WHEN even THEN (2.0 * j - 1) / (2 * j) ELSE 2.0 * j / (2 * j + 1) END)) OVER (PARTITION BY even ORDER BY j) AS c
  FROM (SELECT unnest(range(1, (SELECT max(n) // 2 + 1 FROM rhos))) AS j) AS js, (SELECT unnest([true, false]) AS even) AS es)""")
def spearman(spark, sf):
    return rk.spearman(settle(strategy_table(spark, sf).select("series", "index_score", "target_reg")), "index_score", "target_reg", "series")


@query("average_rank", """
SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY day) + (count(*) OVER (PARTITION BY o_orderstatus, day) - 1) / 2.0::DOUBLE AS rank
FROM (SELECT o_orderkey, o_orderstatus, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders) AS q""", doubles="rank")
def average_rank(spark, sf):
    from .base import table

    days = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.date_diff("o_orderdate", F.lit("1990-01-01").cast("date")).alias("day"))
    return rk.average_rank(days, "day", "o_orderstatus").select("o_orderkey", "rank")


@query("bootstrap_spearman", """
SELECT series, max(ra) FILTER (WHERE rep = 0) AS rho_a, max(rb) FILTER (WHERE rep = 0) AS rho_b, max(ra - rb) FILTER (WHERE rep = 0) AS rho_diff,
  avg(CASE WHEN ra - rb <= 0 THEN 1.0 WHEN ra IS NOT NULL AND rb IS NOT NULL THEN 0.0 END) FILTER (WHERE rep > 0) AS p_value,
  avg(ra - rb) FILTER (WHERE rep > 0) AS boot_mean, count(*) FILTER (WHERE rep > 0) AS replicates
FROM (
  SELECT series, rep, (sum(m * x * z) - sum(m * x) * sum(m * z) / sum(m)) / sqrt((sum(m * x * x) - sum(m * x) * sum(m * x) / sum(m)) * (sum(m * z * z) - sum(m * z) * sum(m * z) / sum(m))) AS ra,
    (sum(m * v * z) - sum(m * v) * sum(m * z) / sum(m)) / sqrt((sum(m * v * v) - sum(m * v) * sum(m * v) / sum(m)) * (sum(m * z * z) - sum(m * z) * sum(m * z) / sum(m))) AS rb
  FROM ranked GROUP BY series, rep) AS r GROUP BY series""", doubles="rho_a rho_b rho_diff p_value boot_mean", with_=f"""WITH {STRATEGY},
s AS (
  SELECT series, index_score AS a, trend_strength AS b, target_reg AS y, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS pos,
    count(*) OVER (PARTITION BY series) AS n FROM strat),
draws AS (
  SELECT series, rep, pos, count(*) AS m
  FROM (SELECT series, rep, ('0x' || substr(md5('42|' || rep || '|' || pos), 1, 13))::BIGINT % n AS pos FROM s, (SELECT unnest(range(1, 1001)) AS rep) AS reps) AS q
  GROUP BY 1, 2, 3 UNION ALL SELECT series, 0, pos, 1 FROM s),
ranked AS (
  SELECT series, rep, m::DOUBLE AS m,
    (sum(m) OVER (PARTITION BY series, rep ORDER BY a) - (sum(m) OVER (PARTITION BY series, rep, a) - 1) / 2.0)::DOUBLE AS x,
    (sum(m) OVER (PARTITION BY series, rep ORDER BY b) - (sum(m) OVER (PARTITION BY series, rep, b) - 1) / 2.0)::DOUBLE AS v,
    (sum(m) OVER (PARTITION BY series, rep ORDER BY y) - (sum(m) OVER (PARTITION BY series, rep, y) - 1) / 2.0)::DOUBLE AS z
  FROM draws JOIN s USING (series, pos))""")
def bootstrap_spearman(spark, sf):
    return inf.bootstrap_spearman(strategy_table(spark, sf), "index_score", "trend_strength", "target_reg", 1000, by="series")


# --- models ----------------------------------------------------------------------------------------

@query("walk_forward_index", None)
def walk_forward_index(spark, sf):
    table = settle(features(spark, sf))
    feats, directions = md.index_features(table.columns)
    return md.walk_forward_index(table, feats, directions).select("date", "index_score")


@query("walk_forward_index_signed", None)
def walk_forward_index_signed(spark, sf):
    table = settle(features(spark, sf))
    feats, directions = md.index_features(table.columns)
    return md.walk_forward_index(table, feats, directions, signed=True, embargo=5).select("date", "index_score")


@query("ablation", None)
def ablation(spark, sf):
    table = settle(features(spark, sf))
    feats, directions = md.index_features(table.columns, drop_regex=fv.SENTIMENT_FEATURES)
    return md.walk_forward_index(table, feats, directions).select("date", "index_score")


@query("walk_forward_vol_egarch", None, digits=10)
def walk_forward_vol_egarch(spark, sf):
    d = md.log_returns(prices(spark, sf), "close", "date", "series", "lr")
    fitted = md.walk_forward_vol(d, "lr", "egarch", by="series", diagnostics=True)
    failed = F.count_if(~F.col("egarch_vol_converged")).over(Window.partitionBy("series"))
    return fitted.select("series", "date", "egarch_vol", "egarch_vol_loglik", "egarch_vol_converged",
                         failed.alias("not_converged"))


def model_table(spark, sf):
    return features(spark, sf).withColumns({
        "target_cls": (F.col("target_reg") > 0).cast("double"), "sample_weight": F.log1p("effective_n")})


CORE = ["sub_index2", "sub_index3", "sub_index4", "sub_index5", "sub_index6", "sub_index7"]
MOOD = ["sent_norm_w", "sent_energy", "sent_std_inv", "neg_z_inv"]


@query("static_index", None)
def static_index(spark, sf):
    return md.static_index(settle(features(spark, sf)), CORE + MOOD, "target_reg", "1999-12-31").select("date", "index_score")


# Closed forms for two features, in which ridge and its leave-one-out errors need no linear algebra.
TWO = ["sub_index2", "sub_index4"]

STATIC_TWO = f"""
rows0 AS (SELECT date, sub_index2 AS x1, sub_index4 AS x2, "log_return_t+1" AS y FROM daily WHERE "log_return_t+1" IS NOT NULL),
m AS (
  SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2
  FROM rows0 WHERE date <= DATE '1996-12-31'),
z AS (SELECT date, n, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2, y - my AS y, date <= DATE '1996-12-31' AS train FROM rows0, m),
g AS (SELECT sum(z1 * z1) AS g11, sum(z1 * z2) AS g12, sum(z2 * z2) AS g22, sum(z1 * y) AS c1, sum(z2 * y) AS c2 FROM z WHERE train),
f AS (
  SELECT p, g.*, (g11 + p) * (g22 + p) - g12 * g12 AS det, ((g22 + p) * c1 - g12 * c2) / ((g11 + p) * (g22 + p) - g12 * g12) AS b1,
    ((g11 + p) * c2 - g12 * c1) / ((g11 + p) * (g22 + p) - g12 * g12) AS b2
  FROM g, (SELECT unnest([0.1, 1.0, 10.0]::DOUBLE[]) AS p) AS ps),
e AS (
  SELECT p, b1, b2, avg(pow((y - b1 * z1 - b2 * z2) / (1 - 1.0 / n - (z1 * z1 * (g22 + p) - 2 * z1 * z2 * g12 + z2 * z2 * (g11 + p)) / det), 2)) AS loss
  FROM f, z WHERE train GROUP BY p, b1, b2),
best AS (SELECT b1, b2 FROM e ORDER BY loss LIMIT 1),
raw AS (SELECT date, train, (b1 * z1 + b2 * z2) / (abs(b1) + abs(b2)) AS r FROM z, best),
ends AS (SELECT quantile_cont(r, 0.01) AS lo, quantile_cont(r, 0.99) AS hi FROM raw WHERE train)"""


@query("static_index_two", "SELECT date, 100.0 * (least(greatest(r, lo), hi) - lo) / (hi - lo) AS index_score FROM raw, ends",
       doubles="index_score", digits=4, with_=f"WITH {DAILY}, {STATIC_TWO}")
def static_index_two(spark, sf):
    table = daily(spark, sf).dropna(subset=["log_return_t+1"]).withColumnRenamed("log_return_t+1", "y")
    return md.static_index(settle(table.select("date", "y", *TWO)), TWO, "y", "1996-12-31").select("date", "index_score")


MONTHS = f"""
mon AS (
  SELECT CAST(date_trunc('month', date) AS DATE) AS date, avg(sub_index2) AS x1, avg(sub_index4) AS x2, sum("log_return_t+1") AS y
  FROM daily WHERE "log_return_t+1" IS NOT NULL GROUP BY 1),
num AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS t FROM mon),
st AS (
  SELECT a.t, a.date, a.x1 AS q1, a.x2 AS q2, count(*) AS n, avg(b.x1) AS m1, stddev_pop(b.x1) AS s1, avg(b.x2) AS m2, stddev_pop(b.x2) AS s2
  FROM num AS a JOIN num AS b ON b.t < a.t - {{embargo}} WHERE a.t >= 36 GROUP BY 1, 2, 3, 4),
zz AS (
  SELECT st.t, n, least(greatest((b.x1 - m1) / s1, -3.0), 3.0) AS z1, least(greatest((b.x2 - m2) / s2, -3.0), 3.0) AS z2, b.y
  FROM st JOIN num AS b ON b.t < st.t - {{embargo}}),
ce AS (
  SELECT t, n, z1 - avg(z1) OVER (PARTITION BY t) AS z1, z2 - avg(z2) OVER (PARTITION BY t) AS z2, y - avg(y) OVER (PARTITION BY t) AS y FROM zz),
gr AS (SELECT t, any_value(n) AS n, sum(z1 * z1) AS g11, sum(z1 * z2) AS g12, sum(z2 * z2) AS g22, sum(z1 * y) AS c1, sum(z2 * y) AS c2 FROM ce GROUP BY t),
fi AS (
  SELECT p, gr.*, (g11 + p) * (g22 + p) - g12 * g12 AS det, ((g22 + p) * c1 - g12 * c2) / ((g11 + p) * (g22 + p) - g12 * g12) AS b1,
    ((g11 + p) * c2 - g12 * c1) / ((g11 + p) * (g22 + p) - g12 * g12) AS b2
  FROM gr, (SELECT unnest({[float(p) for p in md.PENALTIES]}::DOUBLE[]) AS p) AS ps),
lo AS (
  SELECT fi.t, p, b1, b2, avg(pow((y - b1 * z1 - b2 * z2) / (1 - 1.0 / fi.n - (z1 * z1 * (g22 + p) - 2 * z1 * z2 * g12 + z2 * z2 * (g11 + p)) / det), 2)) AS loss
  FROM fi JOIN ce ON ce.t = fi.t GROUP BY 1, 2, 3, 4),
be AS (SELECT t, arg_min(b1, loss) AS b1, -arg_min(b2, loss) AS b2 FROM lo GROUP BY t),
ra AS (
  SELECT date, (b1 * least(greatest((q1 - m1) / s1, -3.0), 3.0) + b2 * least(greatest((q2 - m2) / s2, -3.0), 3.0)) / (abs(b1) + abs(b2) + 1e-12) AS r
  FROM st JOIN be USING (t)),
en AS (SELECT quantile_cont(r, 0.01) AS lo, quantile_cont(r, 0.99) AS hi FROM ra)"""


def months(spark, sf):
    table = daily(spark, sf).dropna(subset=["log_return_t+1"])
    return table.groupBy(F.trunc("date", "month").alias("date")).agg(
        F.avg("sub_index2").alias("sub_index2"), F.avg("sub_index4").alias("sub_index4"), F.sum("log_return_t+1").alias("y"))


@query("walk_forward_index_two", "SELECT date, 100.0 * (least(greatest(r, lo), hi) - lo) / (hi - lo + 1e-12) AS index_score FROM ra, en",
       doubles="index_score", digits=4, with_=f"WITH {DAILY}, {MONTHS.format(embargo=0)}")
def walk_forward_index_two(spark, sf):
    return md.walk_forward_index(settle(months(spark, sf)), TWO, [1, -1], "y", 36).select("date", "index_score")


@query("walk_forward_index_embargo", "SELECT date, 100.0 * (least(greatest(r, lo), hi) - lo) / (hi - lo + 1e-12) AS index_score FROM ra, en",
       doubles="index_score", digits=4, with_=f"WITH {DAILY}, {MONTHS.format(embargo=3)}")
def walk_forward_index_embargo(spark, sf):
    return md.walk_forward_index(settle(months(spark, sf)), TWO, [1, -1], "y", 36, embargo=3).select("date", "index_score")


@query("gbt_compare", None)
def gbt_compare(spark, sf):
    table = settle(model_table(spark, sf))
    traded = md.gbt_compare(table, {"sub": CORE, "sub_sent": CORE + MOOD}, {"reg": "target_reg", "cls": "target_cls"},
                            "1999-12-31", "sample_weight")
    return md.gbt_summary(traded)


@query("ts_cv", None)
def ts_cv(spark, sf):
    errors, _ = md.ts_cv(settle(model_table(spark, sf)), CORE + MOOD)
    return errors


@query("feature_importance", None)
def feature_importance(spark, sf):
    return md.feature_importance(settle(model_table(spark, sf)), CORE + MOOD)


@query("exp_growth", "SELECT series, date, exp(sum(r) OVER (PARTITION BY series ORDER BY date)) AS growth FROM lr", doubles="growth",
       with_=f"WITH {PRICES}, lr AS (SELECT series, date, coalesce(ln(close / lag(close) OVER (PARTITION BY series ORDER BY date)), 0.0) AS r FROM prices)")
def exp_growth(spark, sf):
    return md.exp_growth(md.log_returns(prices(spark, sf), "close", "date", "series", "r"), "r", by="series").select(
        "series", "date", "growth")


@query("strategy_plan", None)
def strategy_plan(spark, sf):
    """Merged daily table to performance: features, walk-forward index, regime, exposure, returns, figures."""
    run = plan.index_and_exposure(settle(features(spark, sf)))
    return rs.perf_metrics(run)


