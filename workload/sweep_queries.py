"""Queries for the parameter sweeps and for sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodloom.functions import fixed_values as fv
from moodloom.operators import classify as cl
from moodloom.operators import filters as fl
from moodloom.operators import sweeps as sw
from moodloom.plans import strategy as plan
from moodloom.sources import sinks, tables as tb
from moodloom.streaming import appends

from .base import COMMENTS, METRIC_COLUMNS, STRATEGY, comments, daily, metrics_sql, query, scratch, strategy_table, table
from .text_queries import HITS, SEEDS, VOCAB, docs, vocab

SWEPT = COMMENTS + """,
c AS (SELECT CAST(comment_at + INTERVAL 9 HOUR AS DATE) AS date, toxicity_score AS tox, (p_pos - p_neg) / (p_pos + p_neg + 1e-8) AS norm FROM comments)"""


@query("sweep_gamma", """
SELECT gamma, pow(0.7, gamma) AS w30, pow(0.5, gamma) AS w50, pow(1 - 0.8::DOUBLE, gamma) AS w80, eff_ratio, mad, maxabs, corr
FROM (SELECT gamma, sum(w) * sum(w) / (sum(w * w) + 1e-8) / count(*) AS eff_ratio FROM g GROUP BY gamma) AS e
JOIN (SELECT gamma, avg(abs(v - base)) AS mad, max(abs(v - base)) AS maxabs, corr(v, base) AS corr FROM series JOIN bases USING (date) GROUP BY gamma) AS m USING (gamma)""",
       doubles="gamma w30 w50 w80 eff_ratio mad maxabs corr", with_=f"""WITH {SWEPT},
g AS (SELECT date, norm, gamma, pow(greatest(1 - tox, 0), gamma) AS w FROM (SELECT *, unnest([0.0, 1.0, 2.0, 3.0, 4.0, 5.0]::DOUBLE[]) AS gamma FROM c) AS q),
series AS (SELECT gamma, date, sum(w * norm) / (sum(w) + 1e-8) AS v FROM g GROUP BY 1, 2),
bases AS (SELECT date, sum(norm) / (count(*) + 1e-8) AS base FROM c GROUP BY 1)""")
def sweep_gamma(spark, sf):
    return sw.sweep_gamma(comments(spark, sf))


@query("gamma_band", """
SELECT month, least(g1, g2, g3) AS row_min, greatest(g1, g2, g3) AS row_max, greatest(g1, g2, g3) - least(g1, g2, g3) AS row_gap
FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS month, avg(v1) AS g1, avg(v2) AS g2, avg(v3) AS g3 FROM (
  SELECT date, sum((1 - tox) * norm) / (sum(1 - tox) + 1e-8) AS v1, sum(pow(1 - tox, 2) * norm) / (sum(pow(1 - tox, 2)) + 1e-8) AS v2,
    sum(pow(1 - tox, 3) * norm) / (sum(pow(1 - tox, 3)) + 1e-8) AS v3 FROM c GROUP BY date) AS d GROUP BY 1) AS m""",
       doubles="row_min row_max row_gap", with_=f"WITH {SWEPT}")
def gamma_band(spark, sf):
    from moodloom.operators.aggregates import monthly_mean, row_spread

    series = sw.gamma_series(comments(spark, sf), "comment_at", "toxicity_score", "p_pos", "p_neg", [1.0, 2.0, 3.0])
    return row_spread(monthly_mean(series, "date", ["g0", "g1", "g2"]), ["g0", "g1", "g2"]).select(
        "month", "row_min", "row_max", "row_gap")


@query("sweep_tau", """
SELECT tau, dropped, dropped_pct, remaining, mad, maxabs
FROM (SELECT tau, count(*) FILTER (WHERE tox >= tau) AS dropped, 100.0 * count(*) FILTER (WHERE tox >= tau) / count(*) AS dropped_pct,
        count(*) FILTER (WHERE NOT tox >= tau) AS remaining FROM t GROUP BY tau) AS d
LEFT JOIN (SELECT tau, avg(abs(v - base)) AS mad, max(abs(v - base)) AS maxabs FROM (
  SELECT tau, date, sum(CASE WHEN tox >= tau THEN 0.0 ELSE w END * norm) / (sum(CASE WHEN tox >= tau THEN 0.0 ELSE w END) + 1e-8) AS v,
    sum(w * norm) / (sum(w) + 1e-8) AS base FROM t WHERE tau <= 0.95 GROUP BY 1, 2) AS s GROUP BY tau) AS m USING (tau)""",
       doubles="tau dropped_pct mad maxabs", with_=f"""WITH {SWEPT},
t AS (SELECT *, unnest([0.80, 0.85, 0.90, 0.93, 0.95, 0.97, 0.99]::DOUBLE[]) AS tau, pow(greatest(1 - tox, 0), 2) AS w FROM c)""")
def sweep_tau(spark, sf):
    return sw.sweep_tau(comments(spark, sf))


def latin(lo: int, hi: int) -> str:
    """Token shape of a window for the Latin test documents."""
    return f"[a-zA-Z]{{{lo},{hi}}}"


@query("sweep_window", """
SELECT "window", count(*) FILTER (WHERE n >= total * 0.2::DOUBLE AND regexp_matches(token, '(?:^th|ou)|(?:er$)|(?:ion)')) AS core
FROM (SELECT "window", token, count(*) AS n FROM w GROUP BY 1, 2) AS q, (SELECT count(*) AS total FROM documents) AS t GROUP BY 1""",
       with_="WITH w AS (" + " UNION ALL ".join(
           f"SELECT DISTINCT '{lo}-{hi}' AS \"window\", doc_id, unnest(regexp_extract_all(lower(text), '{latin(lo, hi)}')) AS token FROM documents"
           for lo, hi in fv.WINDOW_GRID) + ")")
def sweep_window(spark, sf):
    return sw.sweep_window(docs(spark, sf), "text", seeds=SEEDS, min_ratio=0.2, pattern=latin)


def shares_sql(points: list[tuple[str, float, float, float, float]]) -> str:
    """Share of passing documents for (label, ratio, band, core points, support points)."""
    parts = [f"""
SELECT {label} AS label, 100.0 * avg(CASE WHEN nc * {cp} + ns * {sp} >= 150 AND nc > 0 THEN 1.0 ELSE 0.0 END) AS pass_pct,
  count(*) FILTER (WHERE nc * {cp} + ns * {sp} >= 150 AND nc > 0) AS n_pass FROM (
  SELECT d.doc_id, count(*) FILTER (WHERE contains(lower(d.text), v.token) AND v.doc_count >= v.documents * {r}::DOUBLE) AS nc,
    count(*) FILTER (WHERE contains(lower(d.text), v.token) AND v.doc_count < v.documents * {r}::DOUBLE
      AND v.doc_count >= v.documents * {r}::DOUBLE * {b}::DOUBLE) AS ns
  FROM documents AS d LEFT JOIN loose AS v USING (lang) GROUP BY d.doc_id) AS q""" for label, r, b, cp, sp in points]
    return " UNION ALL ".join(parts)


def sizes_sql(points: list[tuple[str, float, float]]) -> str:
    parts = [f"""
SELECT {label} AS label, avg(nc) AS core, avg(ns) AS support FROM (
  SELECT t.lang, count(*) FILTER (WHERE doc_count >= v.documents * {r}::DOUBLE) AS nc,
    count(*) FILTER (WHERE doc_count < v.documents * {r}::DOUBLE AND doc_count >= v.documents * {r}::DOUBLE * {b}::DOUBLE) AS ns
  FROM totals AS t LEFT JOIN loose AS v USING (lang) GROUP BY t.lang) AS q""" for label, r, b in points]
    return " UNION ALL ".join(parts)


def loose(ratio: float, band: float) -> str:
    """Words that any grid point could use."""
    return VOCAB.format(ratio=f"CAST({ratio} AS DOUBLE)", band=f"CAST({band} AS DOUBLE)") + f""",
loose AS (SELECT * FROM vocab WHERE doc_count >= documents * CAST({ratio * band} AS DOUBLE))"""


RATIOS = [0.005, 0.15, 0.2, 0.3]


@query("sweep_df", f"""
SELECT label AS ratio, core, support, pass_pct, n_pass FROM ({sizes_sql([(f'{r}::DOUBLE', r, 0.3) for r in RATIOS])}) AS s
JOIN ({shares_sql([(f'{r}::DOUBLE', r, 0.3, 10, 3) for r in RATIOS])}) AS p USING (label)""",
       doubles="ratio core support pass_pct", with_=f"WITH {loose(0.005, 0.3)}")
def sweep_df(spark, sf):
    return sw.sweep_df(docs(spark, sf), "text", "doc_id", "lang", RATIOS, seeds=SEEDS, cut=150)


@query("sweep_df_words", """
SELECT ratio, token, n, rank FROM (
  SELECT ratio, token, CAST(sum(doc_count) AS BIGINT) AS n, row_number() OVER (PARTITION BY ratio ORDER BY sum(doc_count) DESC, token) AS rank
  FROM (SELECT *, unnest([0.005, 0.15, 0.2, 0.3]::DOUBLE[]) AS ratio FROM counts JOIN totals USING (lang)) AS g
  WHERE doc_count >= documents * ratio GROUP BY 1, 2) AS q WHERE rank <= 30""", doubles="ratio", with_=f"WITH {loose(0.005, 0.3)}")
def sweep_df_words(spark, sf):
    words = sw.sweep_df_words(docs(spark, sf), "text", "lang", RATIOS, seeds=SEEDS)
    return words.withColumn("rank", F.col("rank").cast("bigint"))


@query("sweep_points", shares_sql([(f"'{c}:{s}'", 0.2, 0.3, c, s) for c, s in fv.POINT_GRID]), doubles="pass_pct",
       with_=f"WITH {loose(0.2, 0.3)}")
def sweep_points(spark, sf):
    return sw.sweep_points(docs(spark, sf), "text", "doc_id", "lang", ratio=0.2, seeds=SEEDS, cut=150).select("label", "pass_pct", "n_pass")


@query("sweep_band", f"""
SELECT label AS band, support, pass_pct, n_pass FROM ({sizes_sql([(f'{b}::DOUBLE', 0.2, b) for b in fv.BAND_GRID])}) AS s
JOIN ({shares_sql([(f'{b}::DOUBLE', 0.2, b, 10, 3) for b in fv.BAND_GRID])}) AS p USING (label)""",
       doubles="band support pass_pct", with_=f"WITH {loose(0.2, 0.1)}")
def sweep_band(spark, sf):
    return sw.sweep_band(docs(spark, sf), "text", "doc_id", "lang", ratio=0.2, seeds=SEEDS, cut=150).select(
        "band", "support", "pass_pct", "n_pass")


@query("sweep_cut", """
SELECT cut, 100.0 * avg(CASE WHEN s >= cut AND core_hits > 0 THEN 1.0 ELSE 0.0 END) AS pass_pct,
  100.0 * avg(CASE WHEN s >= cut THEN 1.0 ELSE 0.0 END) AS pass_without_core, count(*) FILTER (WHERE s >= cut AND NOT core_hits > 0) AS aux_only
FROM (SELECT *, core_hits * 10 + support_hits * 3 AS s, unnest([3, 5, 7, 10, 13, 15, 20, 30]::DOUBLE[]) AS cut FROM scored) AS q GROUP BY cut""",
       doubles="cut pass_pct pass_without_core", with_=f"WITH {HITS}")
def sweep_cut(spark, sf):
    filled = fl.drop_empty_text(docs(spark, sf), "text")
    return sw.sweep_cut(cl.score_relevance(filled, "text", vocab(spark, sf), "doc_id", "lang"))


GRID = ", ".join(f"({lo}::DOUBLE, {hi}::DOUBLE, {b}::DOUBLE, {m}::DOUBLE, {c}::DOUBLE)"
                 for lo, hi in fv.MULTIPLIER_GRID for b, m, c in fv.REGIME_GRID)


@query("sweep_exposure", f"""
SELECT *, k_min = 0.5 AND k_max = 1.6 AND bull = 1.2 AND crisis = 0.7 AS adopted FROM ({metrics_sql('gp', 'series, k_min, k_max, bull, normal, crisis')}) AS m""",
       doubles=METRIC_COLUMNS + " k_min k_max bull normal crisis", with_=f"""WITH {STRATEGY},
grid (k_min, k_max, bull, normal, crisis) AS (VALUES {GRID}),
g1 AS (
  SELECT *, CASE WHEN count(target_reg) OVER w3 = 3 THEN sum(target_reg) OVER w3 ELSE 0.0 END AS cumret_3d,
    CASE CAST(trend_strength AS INTEGER) WHEN 1 THEN 0.35 WHEN 2 THEN 0.7 WHEN 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS tw,
    least(greatest(sqrt((0.15 / sqrt(252.0)) / (egarch_vol + 1e-9)), 0.1), 2.0) AS vt
  FROM strat WINDOW w3 AS (PARTITION BY series ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
g2 AS (
  SELECT series, date, target_reg, k_min, k_max, bull, normal, crisis, CASE WHEN vol_shock > 2.0 OR cumret_3d < -0.07 THEN 0.0 ELSE least(greatest(
    tw * vt * least(greatest(k_min + index_score / 100.0 * (k_max - k_min), k_min), k_max)
    * CASE regime WHEN 'bull' THEN bull WHEN 'normal' THEN normal ELSE crisis END, 0.0), 3.0) END AS weight
  FROM g1 CROSS JOIN grid),
gp AS (
  SELECT *, coalesce(lag(weight) OVER w, 0.0) * target_reg
    - abs(coalesce(lag(weight) OVER w, 0.0) - coalesce(lag(weight, 2) OVER w, 0.0)) * 0.00015 AS strat_ret
  FROM g2 WINDOW w AS (PARTITION BY series, k_min, k_max, bull, normal, crisis ORDER BY date))""")
def sweep_exposure(spark, sf):
    return sw.sweep_exposure(strategy_table(spark, sf), by="series")


@query("sweep_pipeline", None)
def sweep_pipeline(spark, sf):
    """Dated comments come from ship dates, so that they cover the days of the price series."""
    q, tax = F.col("l_quantity"), F.col("l_tax")
    rows = table(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("comment_at"), (q / (q + 30.0)).alias("p_pos"), (20.0 / (q + 30.0)).alias("p_neg"),
        (tax * 11.0).alias("toxicity_score"))
    return plan.sweep_pipeline(daily(spark, sf).drop("log_return"), rows, tz=None)


# --- sources and sinks ---------------------------------------------------------------------------------

LATIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜàáâãäåçèéêëìíîïñòóôõöùúûüß"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUaaaaaaceeeeiiiinooooouuuus"


@query("src_csv", f"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, CAST(n_chars AS VARCHAR) AS n_chars, source, charset,
  CASE charset WHEN 'utf-8' THEN concat(text, chr(65533)) ELSE translate(text, '{LATIN}', '{PLAIN}') END AS text
FROM documents, (VALUES ('utf-8'), ('euc-kr'), ('x-windows-949')) AS c (charset)""")
def src_csv(spark, sf):
    """Whole texts, line breaks and quotes included, in three encodings; the reader finds each. Hangul in every row tells
    the encodings apart; the UTF-8 file also holds legal replacement characters."""
    tb.allow_charsets(spark)
    out = None
    for charset in ("utf-8", "euc-kr", "x-windows-949"):
        path = scratch(spark, "csv")
        text = F.concat("text", F.lit("\ufffd")) if charset == "utf-8" else F.translate("text", LATIN, PLAIN)
        docs(spark, sf).select("doc_id", "lang", "n_chars", F.concat(F.lit("출처 "), "source").alias("source"), text.alias("text")).write.option(
            "header", True).option("encoding", charset).option("escape", '"').csv(path)
        read = tb.read_table_smart(spark, path).withColumn("charset", F.lit(charset))
        out = read if out is None else out.unionByName(read)
    return out.withColumn("source", F.regexp_replace("source", "^출처 ", ""))


@query("scan_years", "SELECT o_orderkey, year(o_orderdate) AS year FROM orders WHERE year(o_orderdate) IN (1995, 1996, 1998)")
def scan_years(spark, sf):
    path = scratch(spark, "years")
    orders = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    orders.write.partitionBy("year").parquet(path)
    return tb.read_years(spark, path, "1995-1996,1998").select("o_orderkey", F.col("year").cast("bigint"))


@query("union_years", """
SELECT o_orderkey, o_orderstatus, CASE WHEN year(o_orderdate) = 1996 THEN o_orderpriority END AS o_orderpriority
FROM orders WHERE year(o_orderdate) IN (1995, 1996)""")
def union_years(spark, sf):
    orders = table(spark, sf, "orders")
    return tb.union_years([
        fl.filter_year(orders, "o_orderdate", 1995).select("o_orderkey", "o_orderstatus"),
        fl.filter_year(orders, "o_orderdate", 1996).select("o_orderkey", "o_orderstatus", "o_orderpriority")])


@query("write_split", """
SELECT year(o_orderdate) AS year, CASE WHEN o_orderstatus = 'F' THEN 'kept' ELSE 'dropped' END AS disposition, count(*) AS n
FROM orders GROUP BY 1, 2""")
def write_split(spark, sf):
    path = scratch(spark, "split")
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    sinks.write_split(orders, path, F.when(F.col("o_orderstatus") == "F", "kept").otherwise("dropped"))
    return spark.read.parquet(path).groupBy(F.col("year").cast("bigint").alias("year"), "disposition").agg(
        F.count(F.lit(1)).alias("n"))


SPLIT_AGAIN = """
SELECT year(o_orderdate) AS year, {kept} AS disposition, count(*) AS n FROM orders WHERE {where} GROUP BY 1, 2"""


def split_counts(spark, path):
    return spark.read.parquet(path).groupBy(F.col("year").cast("bigint").alias("year"), "disposition").agg(F.count(F.lit(1)).alias("n"))


@query("write_split_rerun", SPLIT_AGAIN.format(
    kept="CASE WHEN year(o_orderdate) = 1995 OR o_orderstatus = 'F' THEN 'kept' ELSE 'dropped' END", where="true"))
def write_split_rerun(spark, sf):
    """A rerun of one year with another cut leaves nothing of the first run in that year, and other years alone."""
    path = scratch(spark, "split")
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    sinks.write_split(orders, path, F.when(F.col("o_orderstatus") == "F", "kept").otherwise("dropped"))
    sinks.write_split(orders.where("year = 1995"), path, F.lit("kept"))
    return split_counts(spark, path)


@query("write_split_new_year", SPLIT_AGAIN.format(
    kept="CASE WHEN year(o_orderdate) > 1995 THEN 'kept' WHEN o_orderstatus = 'F' THEN 'kept' ELSE 'dropped' END", where="true"))
def write_split_new_year(spark, sf):
    """Without overwriting, years that are there stay as they are and new ones are added."""
    path = scratch(spark, "split")
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    cut = F.when(F.col("o_orderstatus") == "F", "kept").otherwise("dropped")
    sinks.write_split(orders.where("year <= 1995"), path, cut, overwrite=False)
    sinks.write_split(orders, path, F.lit("kept"), overwrite=False)
    return split_counts(spark, path)


@query("write_summary_two_years", """
SELECT year(o_orderdate) AS year, CASE WHEN year(o_orderdate) = 1995 THEN -1 ELSE count(*) END AS total,
  array_to_string(list_sort(list(DISTINCT o_orderpriority)), ';') AS words FROM orders GROUP BY 1""")
def write_summary_two_years(spark, sf):
    """Years are written one call each, with nested lists; the last call replaces one of them only."""
    path = scratch(spark, "summary")
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    figures = orders.groupBy("year").agg(F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_set("o_orderpriority")).alias("words"))
    sinks.write_summary(figures.where("year <= 1995"), path)
    sinks.write_summary(figures.where("year >= 1995"), path, overwrite=False)
    sinks.write_summary(figures.where("year = 1995").withColumn("total", F.lit(-1).cast("bigint")), path)
    read = spark.read.schema("total bigint, words array<string>, year bigint").json(path)
    return read.select("year", "total", F.array_join("words", ";").alias("words"))


@query("write_summary", "SELECT year(o_orderdate) AS year, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS kept FROM orders GROUP BY 1")
def write_summary(spark, sf):
    path = scratch(spark, "summary")
    summary = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("kept"))
    sinks.write_summary(summary, path)
    return spark.read.schema("total bigint, kept bigint, year bigint").json(path)


@query("incremental_append", """
SELECT user_id, comment_id, event_id FROM (
  SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS comment_id, event_id, ts,
    row_number() OVER (PARTITION BY user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) ORDER BY event_id) AS r
  FROM events WHERE ts >= TIMESTAMP '2024-01-15') AS n
WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM events AS o WHERE o.ts < TIMESTAMP '2024-01-15' AND o.user_id = n.user_id
  AND CAST(json_extract_string(o.props, '$.k') AS BIGINT) = n.comment_id)""")
def incremental_append(spark, sf):
    rows = table(spark, sf, "events").select(
        "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("comment_id"), "event_id", "ts")
    cut = F.lit("2024-01-15").cast("timestamp")
    fresh = sinks.incremental_append(rows.where(F.col("ts") >= cut), rows.where(F.col("ts") < cut),
                                     ["user_id", "comment_id"], "event_id")
    return fresh.select("user_id", "comment_id", "event_id")


@query("append_news_and_comments", """
SELECT comment_id, news_id FROM (
  SELECT event_id % 997 AS comment_id, user_id AS news_id, event_id, row_number() OVER (PARTITION BY event_id % 997 ORDER BY event_id) AS r
  FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-20' AND user_id % 2 = 0)) AS n
WHERE r = 1 AND comment_id NOT IN (SELECT event_id % 997 FROM events WHERE ts < TIMESTAMP '2024-01-03')""")
def append_news_and_comments(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("news_id"), (F.col("event_id") % 997).alias("comment_id"), "event_id", "ts")
    cut = F.lit("2024-01-20").cast("timestamp")
    batch, known = rows.where(F.col("ts") >= cut), rows.where((F.col("ts") < cut) & (F.col("news_id") % 2 == 0))
    seen = rows.where(F.col("ts") < F.lit("2024-01-03").cast("timestamp"))
    _, fresh = sinks.append_news_and_comments(batch.select("news_id").distinct(), batch, known, seen, "event_id")
    return fresh.select("comment_id", "news_id")


def stream_of(spark, df, name):
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query("unseen_comments_stream", "SELECT DISTINCT user_id AS comment_id FROM events")
def unseen_comments_stream(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("comment_id"), "ts")
    out = scratch(spark, "unseen")
    stream = appends.unseen_comments(stream_of(spark, rows, "source"), "ts", "comment_id", "60 days")
    appends.append_writer(stream, out, out.rsplit("/", 1)[-1]).start().awaitTermination()
    return spark.read.parquet(out).select("comment_id")


@query("append_stream", "SELECT user_id AS comment_id, count(*) FILTER (WHERE d = 1) AS copies FROM "
       "(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events) AS e GROUP BY user_id")
def append_stream(spark, sf):
    """Comments in batches by time, stopped after two thirds of the files and started again: every id once."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("comment_id"), "ts")
    source, out = scratch(spark, "arrivals"), scratch(spark, "appended")
    late = F.col("ts") >= F.lit("2024-01-20").cast("timestamp")
    for part, files in ((rows.where(~late), 4), (rows.where(late), 2)):
        part.repartitionByRange(files, "ts").write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
        appends.append_stream(stream, out, out.rsplit("/", 1)[-1], "comment_id", "ts").start().awaitTermination()
    return spark.read.parquet(out).groupBy("comment_id").agg(F.count(F.lit(1)).alias("copies"))


@query("daily_sentiment_stream", """
SELECT date, count(*) AS comment_count, sum(w) AS weight_sum, sum(w * w) AS weight_sq_sum,
  sum(norm * w) / (sum(w) + 1e-8) AS sent_norm_w, sum(p_pos * w) / (sum(w) + 1e-8) AS pos_mean_w, sum(p_neg * w) / (sum(w) + 1e-8) AS neg_mean_w
FROM (SELECT *, CAST(comment_at + INTERVAL 9 HOUR AS DATE) AS date, greatest(coalesce(TRY_CAST(weight AS DOUBLE), 1.0), 0.0) AS w,
        (p_pos - p_neg) / (p_pos + p_neg + 1e-8) AS norm FROM comments) AS c
WHERE CAST(date_trunc('day', comment_at + INTERVAL 9 HOUR) + INTERVAL 1 DAY AS TIMESTAMP) <= (SELECT max(ts) + INTERVAL 9 HOUR - INTERVAL 2 DAY FROM events)
GROUP BY date""", doubles="weight_sum weight_sq_sum sent_norm_w pos_mean_w neg_mean_w", with_=f"WITH {COMMENTS}")
def daily_sentiment_stream(spark, sf):
    """Days the watermark has closed; the last two days are still open."""
    out = scratch(spark, "daily")
    source = stream_of(spark, comments(spark, sf).select("comment_at", "p_pos", "p_neg", "weight"), "source")
    daily_rows = appends.daily_sentiment_stream(source, "comment_at", "p_pos", "p_neg", "weight")
    appends.append_writer(daily_rows, out, out.rsplit("/", 1)[-1]).start().awaitTermination()
    return spark.read.parquet(out)
