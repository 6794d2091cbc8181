"""Queries over documents, labels, pages and event payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodloom.functions import text as tx
from moodloom.operators import aggregates as ag
from moodloom.operators import classify as cl
from moodloom.operators import extract as ex
from moodloom.operators import filters as fl
from moodloom.operators import joining as jn
from moodloom.plans import cascade

from .base import query, table, text_table

# Lexicons that fit the invented prose of the test documents.
PATTERNS = ["tionth|ndre|MB", "heit|The", "ción"]
CATEGORIES = {"direct_abuse": ["ouxx|ingth|ererer", "ververb"], "hate_slur": ["edand|keitst"], "sexual": ["auxré|osla|anthe"]}
SEEDS = ["^th|ou", "er$", "ion"]
TOPICS = {"alpha": "edhan|ingth", "beta": "heit.?en|chst", "gamma": "mentre|AUX.?EAU", "delta": "ción"}

_A = "regexp_extract_all(text, '(?i)(?:ouxx|ingth|ererer)|(?:ververb)')"
_H = "regexp_extract_all(text, '(?i)(?:edand|keitst)')"
_S = "regexp_extract_all(text, '(?i)(?:auxré|osla|anthe)')"
TOXIC = f"""
tox0 AS (
  SELECT *, len({_A}) AS na, len({_H}) AS nh, len({_S}) AS ns FROM documents),
tox1 AS (
  SELECT *,
    CASE WHEN na >= 2 THEN 0.67 WHEN na = 1 THEN 0.55 ELSE 0 END::DOUBLE
    + CASE WHEN nh >= 2 THEN 0.77 WHEN nh = 1 THEN 0.65 ELSE 0 END::DOUBLE
    + CASE WHEN ns >= 2 THEN 0.87 WHEN ns = 1 THEN 0.75 ELSE 0 END::DOUBLE AS base,
    regexp_matches(text, '\\S') AS filled
  FROM tox0),
tox AS (
  SELECT doc_id, text, lang, source, filled,
    CASE WHEN filled THEN least(base + CASE WHEN length(text) <= 3 AND base > 0 THEN 0.10 ELSE 0 END, 1.0) ELSE 1.0 END::DOUBLE AS toxicity_score,
    CASE WHEN NOT filled THEN 'empty' ELSE array_to_string(list_filter([
      CASE WHEN na > 0 THEN 'direct_abuse' END, CASE WHEN nh > 0 THEN 'hate_slur' END, CASE WHEN ns > 0 THEN 'sexual' END],
      lambda r: r IS NOT NULL), '|') END AS toxicity_reason
  FROM tox1)"""
KEEP = TOXIC + """,
kept AS (
  SELECT *, pow(greatest(1.0 - toxicity_score, 0.0), 2.0) * CASE WHEN filled THEN 1 ELSE 0 END AS weight,
         filled AND toxicity_score < 0.95 AS keep FROM tox)"""
FLAG = "regexp_matches(lower(text), '(?:tionth|ndre|MB)|(?:heit|The)|(?:ción)')"


def docs(spark, sf):
    return text_table(spark, sf, "documents")


def toxic_docs(spark, sf):
    scored = cl.lexicon_toxicity(docs(spark, sf), "text", CATEGORIES)
    return cl.toxicity_weight(scored, "text")


@query("filter_summary", f"""
SELECT lang, count(*) AS total,
  count(*) FILTER (WHERE {FLAG}) AS political, 100.0 * count(*) FILTER (WHERE {FLAG}) / count(*) AS political_pct,
  count(*) FILTER (WHERE NOT filled) AS empty_rows, 100.0 * count(*) FILTER (WHERE NOT filled) / count(*) AS empty_rows_pct,
  count(*) FILTER (WHERE keep) AS kept, 100.0 * count(*) FILTER (WHERE keep) / count(*) AS kept_pct,
  avg(toxicity_score) FILTER (WHERE filled) AS mean_toxicity, avg(weight) AS mean_weight
FROM kept GROUP BY lang""", doubles="political_pct empty_rows_pct kept_pct mean_toxicity mean_weight", with_=f"WITH {KEEP}")
def filter_summary(spark, sf):
    return cascade.filter_summary(docs(spark, sf), "lang", "text", PATTERNS, categories=CATEGORIES)


@query("drop_empty_text", r"""
SELECT conv_id, turn, length(text) AS chars FROM conversations WHERE regexp_matches(text, '\S')""")
def drop_empty_text(spark, sf):
    return fl.drop_empty_text(table(spark, sf, "conversations"), "text").select(
        "conv_id", "turn", F.length("text").cast("bigint").alias("chars"))


@query("flag_patterns", f"SELECT doc_id, {FLAG} AS is_political FROM documents")
def flag_patterns(spark, sf):
    return cl.flag_patterns(docs(spark, sf), "text", PATTERNS).select("doc_id", "is_political")


_WORDS = "['MB', 'The', 'ción', 'heit', 'ndre', 'tionth']"


@query("match_keywords", f"""
SELECT doc_id, array_to_string(words, ',') AS words, CAST(len(words) AS BIGINT) AS keyword_count
FROM (SELECT doc_id, list_filter({_WORDS}, lambda w: contains(lower(text), lower(w))) AS words FROM documents) AS q""")
def match_keywords(spark, sf):
    return cl.match_keywords(docs(spark, sf), "text", PATTERNS).select(
        "doc_id", F.array_join("matched_keywords", ",").alias("words"), F.col("keyword_count").cast("bigint"))


@query("lexicon_toxicity", "SELECT doc_id, toxicity_score, toxicity_reason FROM tox", doubles="toxicity_score",
       with_=f"WITH {TOXIC}")
def lexicon_toxicity(spark, sf):
    return cl.lexicon_toxicity(docs(spark, sf), "text", CATEGORIES).select("doc_id", "toxicity_score", "toxicity_reason")


@query("toxicity_weight", """
SELECT doc_id, least(greatest(s, 0.0), 1.0) AS toxicity_score, pow(greatest(1.0 - least(s, 1.0), 0.0), 3.0) AS weight,
  s < 0.95 AS keep, s < 0.5 AS keep_drop
FROM (SELECT doc_id, coalesce(toxic * 0.8 + quality * 0.17 + n_chars / 100000.0, 0.0) AS s
      FROM documents LEFT JOIN labels USING (doc_id)) AS q""", doubles="toxicity_score weight")
def toxicity_weight(spark, sf):
    joined = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").withColumn(
        "toxicity_score", F.col("toxic") * 0.8 + F.col("quality") * 0.17 + F.col("n_chars") / 100000.0)
    weighted = cl.toxicity_weight(joined, "text", gamma=3.0, model=True)
    dropped = cl.toxicity_weight(joined, "text", mode="drop", tau=0.5, model=True)
    return weighted.select("doc_id", "toxicity_score", "weight", "keep").join(
        dropped.select("doc_id", F.col("keep").alias("keep_drop")), "doc_id")


VOCAB = """
toks AS (
  SELECT DISTINCT lang, doc_id, unnest(regexp_extract_all(lower(text), '[가-힣]{{2,6}}|[a-zA-Z]{{2,10}}')) AS token
  FROM documents WHERE regexp_matches(text, '\\S')),
totals AS (SELECT lang, count(*) AS documents FROM documents WHERE regexp_matches(text, '\\S') GROUP BY lang),
counts AS (SELECT lang, token, count(*) AS doc_count FROM toks
           WHERE regexp_matches(token, '(?:^th|ou)|(?:er$)|(?:ion)') GROUP BY 1, 2),
vocab AS (
  SELECT lang, token, doc_count, documents,
    CASE WHEN doc_count >= documents * {ratio} THEN 'core' WHEN doc_count >= documents * {ratio} * {band} THEN 'support' END AS kind,
    100.0 * doc_count / documents AS pct
  FROM counts JOIN totals USING (lang))"""
VOCAB_20 = VOCAB.format(ratio="CAST(0.2 AS DOUBLE)", band="CAST(0.3 AS DOUBLE)")


def vocab(spark, sf):
    return cl.keyword_df(docs(spark, sf), "text", None, SEEDS, "lang", 0.2)


@query("keyword_df", "SELECT lang, token, kind, doc_count, pct FROM vocab WHERE kind IS NOT NULL", doubles="pct",
       with_=f"WITH {VOCAB_20}")
def keyword_df(spark, sf):
    return vocab(spark, sf)


HITS = VOCAB_20 + """,
packed AS (SELECT lang, list(token) FILTER (WHERE kind = 'core') AS core, list(token) FILTER (WHERE kind = 'support') AS support
           FROM vocab WHERE kind IS NOT NULL GROUP BY lang),
scored AS (
  SELECT doc_id, lang,
    coalesce(len(list_filter(core, lambda w: contains(lower(text), w))), 0) AS core_hits,
    coalesce(len(list_filter(support, lambda w: contains(lower(text), w))), 0) AS support_hits
  FROM documents LEFT JOIN packed USING (lang) WHERE regexp_matches(text, '\\S'))"""


@query("score_relevance", """
SELECT doc_id, CAST(core_hits AS BIGINT) AS core_hits, CAST(support_hits AS BIGINT) AS support_hits,
  CAST(core_hits * 10 + support_hits * 3 AS BIGINT) AS stock_score,
  CASE WHEN core_hits * 10 + support_hits * 3 >= 150 AND core_hits > 0 THEN 'stock' ELSE 'other' END AS is_stock
FROM scored""", with_=f"WITH {HITS}")
def score_relevance(spark, sf):
    filled = fl.drop_empty_text(docs(spark, sf), "text")
    scored = cl.score_relevance(filled, "text", vocab(spark, sf), "doc_id", "lang", cut=150)
    return scored.select("doc_id", *[F.col(c).cast("bigint") for c in ("core_hits", "support_hits", "stock_score")],
                         "is_stock")


@query("score_filter", """
SELECT doc_id FROM scored WHERE core_hits * 10 + support_hits * 3 >= 150 AND core_hits > 0""", with_=f"WITH {HITS}")
def score_filter(spark, sf):
    filled = fl.drop_empty_text(docs(spark, sf), "text")
    scored = cl.score_relevance(filled, "text", vocab(spark, sf), "doc_id", "lang")
    return fl.score_filter(scored, "stock_score", 150, "core_hits").select("doc_id")


TOPIC = """
topics AS (
  SELECT doc_id, n_chars, CASE WHEN regexp_matches(text, '(?i)edhan|ingth') THEN 'alpha'
    WHEN regexp_matches(text, '(?i)heit.?en|chst') THEN 'beta'
    WHEN regexp_matches(text, '(?i)mentre|AUX.?EAU') THEN 'gamma'
    WHEN regexp_matches(text, '(?i)ción') THEN 'delta' ELSE 'none' END AS topic
  FROM documents)"""


@query("assign_topic", "SELECT doc_id, topic FROM topics", with_=f"WITH {TOPIC}")
def assign_topic(spark, sf):
    return cl.assign_topic(docs(spark, sf), "text", TOPICS, "none").select("doc_id", "topic")


@query("topic_mass", "SELECT topic, CAST(sum(n_chars) AS BIGINT) AS mass, count(*) AS n FROM topics GROUP BY topic",
       with_=f"WITH {TOPIC}")
def topic_mass(spark, sf):
    return ag.topic_mass(docs(spark, sf), "text", "n_chars", TOPICS, "none")


@query("score_text", r"""
SELECT doc_id, pos / (pos + neg + 1.0) AS p_pos, 1.0 / (pos + neg + 1.0) AS p_neu, neg / (pos + neg + 1.0) AS p_neg
FROM (SELECT doc_id, len(regexp_extract_all(text, '(?i)(?:tion)|(?:heit)'))::DOUBLE AS pos,
             len(regexp_extract_all(text, '(?i)(?:ing)|(?:eau)'))::DOUBLE AS neg
      FROM documents WHERE regexp_matches(text, '\S')) AS q""", doubles="p_pos p_neu p_neg")
def score_text(spark, sf):
    scorer = cl.lexicon_scorer(["tion", "heit"], ["ing", "eau"])
    return cl.score_text(docs(spark, sf).select("doc_id", "text"), "text", scorer, ["p_pos", "p_neu", "p_neg"]).drop("text")


@query("token_length_profile", """
SELECT CAST(length(token) AS BIGINT) AS token_length, count(*) AS tokens,
  avg(CASE WHEN regexp_matches(token, '(?:^th|ou)|(?:er$)|(?:ion)') THEN 1.0 ELSE 0.0 END) AS seed_share
FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zA-Z]+')) AS token FROM documents) AS q
WHERE length(token) <= 10 GROUP BY 1""", doubles="seed_share")
def token_length_profile(spark, sf):
    profile = cl.token_length_profile(docs(spark, sf), "text", SEEDS, "[a-zA-Z]+")
    return profile.withColumn("token_length", F.col("token_length").cast("bigint"))


@query("seed_tokens", """
SELECT token, count(*) AS n
FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zA-Z]+')) AS token FROM documents) AS q
WHERE length(token) >= 7 AND regexp_matches(token, '(?:^th|ou)|(?:er$)|(?:ion)')
GROUP BY token ORDER BY n DESC, token LIMIT 8""")
def seed_tokens(spark, sf):
    return cl.seed_tokens(docs(spark, sf), "text", 7, None, 8, SEEDS, "[a-zA-Z]+")


@query("decode_list_text", """
SELECT doc_id, unnest(list_filter(['MB', 'The', 'ción', 'heit', 'ndre', 'tionth'], lambda w: contains(lower(text), lower(w)))) AS item
FROM documents""")
def decode_list_text(spark, sf):
    found = cl.match_keywords(docs(spark, sf), "text", PATTERNS)
    quoted = F.concat(F.lit("['"), F.array_join("matched_keywords", "', '"), F.lit("']"))
    text = found.select("doc_id", F.when(F.col("keyword_count") > 0, quoted).otherwise("[]").alias("written"))
    return cl.decode_list_text(text, "written").select("doc_id", "item")


@query("top_keywords", """
SELECT lang, item, n FROM (
  SELECT lang, item, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, item) AS r
  FROM (SELECT lang, unnest(list_filter(['MB', 'The', 'ción', 'heit', 'ndre', 'tionth'],
        lambda w: contains(lower(text), lower(w)))) AS item FROM documents) AS q
  GROUP BY lang, item) AS c WHERE r <= 3""")
def top_keywords(spark, sf):
    return ag.top_keywords(cl.match_keywords(docs(spark, sf), "text", PATTERNS), "matched_keywords", 3, "lang")


@query("reason_counts", """
SELECT CASE WHEN toxicity_reason = '' THEN 'unknown' ELSE toxicity_reason END AS item, count(*) AS n
FROM kept WHERE NOT keep GROUP BY 1 ORDER BY n DESC, item LIMIT 20""", with_=f"WITH {KEEP}")
def reason_counts(spark, sf):
    return ag.top_keywords(toxic_docs(spark, sf).where(~F.col("keep")), "toxicity_reason", 20)


@query("stage_summary", """
SELECT lang, count(*) AS total, count(*) FILTER (WHERE is_stock) AS stock,
  100.0 * count(*) FILTER (WHERE is_stock) / count(*) AS stock_pct,
  avg(score) FILTER (WHERE is_stock) AS avg_score, median(score) FILTER (WHERE is_stock) AS median_score
FROM (SELECT lang, CAST(core_hits * 10 + support_hits * 3 AS DOUBLE) AS score,
      core_hits * 10 + support_hits * 3 >= 150 AND core_hits > 0 AS is_stock FROM scored) AS q
GROUP BY lang""", doubles="stock_pct avg_score median_score", with_=f"WITH {HITS}")
def stage_summary(spark, sf):
    filled = fl.drop_empty_text(docs(spark, sf), "text")
    scored = cl.score_relevance(filled, "text", vocab(spark, sf), "doc_id", "lang", cut=150)
    passed = F.col("is_stock") == "stock"
    score = F.when(passed, F.col("stock_score"))
    return ag.stage_summary(scored, {"stock": passed}, "lang", {"avg_score": score}, {"median_score": score})


FUNNEL = KEEP + f""",
stages AS (
  SELECT lang, filled AS s1, filled AND NOT {FLAG} AS s2, filled AND NOT {FLAG} AND keep AS s3,
         filled AND NOT {FLAG} AND keep AND coalesce(quality = 1, false) AS s4
  FROM kept LEFT JOIN labels USING (doc_id)),
per AS (
  SELECT lang, CAST(grouping(lang) AS INTEGER) AS is_total, count(*) AS raw, count(*) FILTER (WHERE s1) AS n1,
    count(*) FILTER (WHERE s2) AS n2, count(*) FILTER (WHERE s3) AS n3, count(*) FILTER (WHERE s4) AS n4
  FROM stages GROUP BY ROLLUP (lang))"""


@query("funnel", """
SELECT lang, is_total, step, stage, entered, passed, entered - passed AS removed,
  CASE WHEN entered > 0 THEN 100.0 * (entered - passed) / entered END AS removed_pct,
  CASE WHEN raw > 0 THEN 100.0 * passed / raw END AS retained_pct
FROM (
  SELECT lang, is_total, raw, 1 AS step, 'filled' AS stage, raw AS entered, n1 AS passed FROM per
  UNION ALL SELECT lang, is_total, raw, 2, 'political', n1, n2 FROM per
  UNION ALL SELECT lang, is_total, raw, 3, 'toxicity', n2, n3 FROM per
  UNION ALL SELECT lang, is_total, raw, 4, 'quality', n3, n4 FROM per) AS q""",
       doubles="removed_pct retained_pct", with_=f"WITH {FUNNEL}")
def funnel(spark, sf):
    staged = cl.flag_patterns(toxic_docs(spark, sf), "text", PATTERNS).join(
        table(spark, sf, "labels"), "doc_id", "left")
    return ag.funnel(staged, {"filled": ~F.col("is_empty"), "political": ~F.col("is_political"),
                              "toxicity": F.col("keep"), "quality": F.col("quality") == 1}, "lang")


@query("corpus_stats", r"""
SELECT lang, raw, non_empty, n_articles, 100.0 * (raw - non_empty) / raw AS empty_rate,
  non_empty / greatest(n_articles, 1) AS rows_per_article
FROM (SELECT lang, count(*) AS raw, count(*) FILTER (WHERE regexp_matches(text, '\S')) AS non_empty,
      count(DISTINCT source) AS n_articles FROM documents GROUP BY lang) AS q""", doubles="empty_rate rows_per_article")
def corpus_stats(spark, sf):
    return ag.corpus_stats(docs(spark, sf), "lang", "text", "source")


@query("band_counts", """
SELECT CAST(band AS DOUBLE) AS band, count(*) AS n,
  array_to_string(list(doc_id ORDER BY s, doc_id)[1:4], ',') AS lowest
FROM (SELECT doc_id, s, CASE WHEN s >= 0.0 AND s < 0.02 THEN 0.0 WHEN s >= 0.02 AND s < 0.05 THEN 0.02
        WHEN s >= 0.05 AND s < 0.10 THEN 0.05 WHEN s >= 0.10 AND s < 1.01 THEN 0.10 END AS band
      FROM (SELECT doc_id, n_chars / 100000.0 AS s FROM documents) AS d) AS q
WHERE band IS NOT NULL GROUP BY band""", doubles="band")
def band_counts(spark, sf):
    d = docs(spark, sf).withColumn("s", F.col("n_chars") / 100000.0).withColumn("sample", F.col("doc_id").cast("string"))
    out = ag.band_counts(d, "s", [0.0, 0.02, 0.05, 0.10, 1.01], 4, "sample", "doc_id")
    return out.select("band", "n", F.array_join("samples", ",").alias("lowest"))


@query("exceed_by_group", """
SELECT lang, 100.0 * avg(CASE WHEN toxicity_score >= 0.95 THEN 1.0 ELSE 0.0 END) AS pct, count(*) AS n
FROM tox GROUP BY lang""", doubles="pct", with_=f"WITH {TOXIC}")
def exceed_by_group(spark, sf):
    return ag.exceed_by_year(toxic_docs(spark, sf), "toxicity_score", 0.95, "lang")


@query("join_scores", """
SELECT doc_id, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)""")
def join_scores(spark, sf):
    scores = table(spark, sf, "labels")
    twice = scores.unionByName(scores)
    return jn.join_scores(docs(spark, sf).select("doc_id", "n_chars"), twice, "doc_id")


@query("filter_flags", """
SELECT doc_id, quality, toxic FROM labels WHERE quality = 1 AND NOT toxic = 1""")
def filter_flags(spark, sf):
    flags = table(spark, sf, "labels").withColumns({
        "keep": F.when(F.col("quality") == 1, "True").otherwise("False"), "is_empty": F.col("toxic")})
    return fl.filter_flags(flags).select("doc_id", "quality", "toxic")


@query("stratified_sample", """
SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) AS r FROM documents) AS q
WHERE r <= 40""")
def stratified_sample(spark, sf):
    return ag.stratified_sample(docs(spark, sf), "lang", 40, "doc_id", 7).select("doc_id", "lang", "source")


@query("normalize_space", r"""
SELECT doc_id, md5(trim(regexp_replace(
  replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&amp;', '&'),
  '[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS digest
FROM documents""")
def normalize_space(spark, sf):
    return ex.normalize_space(docs(spark, sf), "text").select("doc_id", F.md5("text").alias("digest"))


@query("strip_tags", r"""
SELECT page_id, md5(trim(regexp_replace(
  regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&quot;', '"'),
    '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'),
  '[\s\x{00a0}]+', ' ', 'g'))) AS digest
FROM pages""")
def strip_tags(spark, sf):
    return ex.strip_tags(text_table(spark, sf, "pages"), "html").select("page_id", F.md5("html").alias("digest"))


@query("extract_ids", r"""
SELECT page_id, coalesce(a, c) AS first_id, coalesce(b, d) AS second_id,
  CASE WHEN coalesce(a, c) IS NOT NULL THEN 'https://example.org/' || coalesce(a, c) || '/' || coalesce(b, d) END AS canonical
FROM (
  SELECT page_id, nullif(regexp_extract(path, '^/(en|fr)/([0-9]+)', 1), '') AS a, nullif(regexp_extract(path, '^/(en|fr)/([0-9]+)', 2), '') AS b,
    CASE WHEN regexp_matches(url, '[?&]page=[^&#]+') AND regexp_matches(url, '[?&]ref=[^&#]+') THEN regexp_extract(url, '[?&]page=([^&#]+)', 1) END AS c,
    CASE WHEN regexp_matches(url, '[?&]page=[^&#]+') AND regexp_matches(url, '[?&]ref=[^&#]+') THEN regexp_extract(url, '[?&]ref=([^&#]+)', 1) END AS d
  FROM (SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages) AS p) AS q""")
def extract_ids(spark, sf):
    found = ex.extract_ids(text_table(spark, sf, "pages"), "url", "^/(en|fr)/([0-9]+)", ("page", "ref"),
                           "https://example.org/%s/%s", (".+", ".+"))
    return found.select("page_id", "first_id", "second_id", "canonical")


# Test pages link to /word: the first letter and the rest of the word serve as the two ids.
@query("extract_links", r"""
SELECT page_id, first_id, second_id, title FROM (
  SELECT page_id, first_id, second_id, title, row_number() OVER (PARTITION BY page_id, first_id, second_id ORDER BY pos) AS r
  FROM (
    SELECT page_id, pos, regexp_extract(href, '^/([a-z])([a-z]+)$', 1) AS first_id, regexp_extract(href, '^/([a-z])([a-z]+)$', 2) AS second_id,
      trim(regexp_replace(replace(regexp_replace(title, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '\s+', ' ', 'g')) AS title
    FROM (
      SELECT page_id, generate_subscripts(m, 1) AS pos,
        unnest(list_transform(m, lambda x: concat(regexp_extract(x, '(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]+)"|''([^'']+)''|([^\s"''>]+))[^>]*>(.*?)</a\s*>', 1), regexp_extract(x, '(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]+)"|''([^'']+)''|([^\s"''>]+))[^>]*>(.*?)</a\s*>', 2), regexp_extract(x, '(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]+)"|''([^'']+)''|([^\s"''>]+))[^>]*>(.*?)</a\s*>', 3)))) AS href,
        unnest(list_transform(m, lambda x: regexp_extract(x, '(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]+)"|''([^'']+)''|([^\s"''>]+))[^>]*>(.*?)</a\s*>', 4))) AS title
      FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]+)"|''([^'']+)''|([^\s"''>]+))[^>]*>(.*?)</a\s*>') AS m FROM (SELECT page_id, html AS html FROM pages) AS h) AS a
    ) AS b
  ) AS c WHERE first_id <> ''
) AS d WHERE r = 1""")
def extract_links(spark, sf):
    """Links as the pages have them."""
    pages = text_table(spark, sf, "pages").withColumn("html", F.col("html"))
    links = ex.extract_links(pages, "html", "url", "page_id", path="^/([a-z])([a-z]+)$", query_keys=None, template="/%s%s")
    return links.select("page_id", "first_id", "second_id", "title")


@query("extract_links_quoting", r"""
SELECT page_id, first_id, second_id, title FROM (
  SELECT page_id, first_id, second_id, title, row_number() OVER (PARTITION BY page_id, first_id, second_id ORDER BY pos) AS r
  FROM (
    SELECT page_id, pos, regexp_extract(href, '^/([a-z])([a-z]+)$', 1) AS first_id, regexp_extract(href, '^/([a-z])([a-z]+)$', 2) AS second_id,
      trim(regexp_replace(replace(regexp_replace(title, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '\s+', ' ', 'g')) AS title
    FROM (
      SELECT page_id, generate_subscripts(m, 1) AS pos,
        unnest(list_transform(m, lambda x: concat(regexp_extract(x, '(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]+)"|''([^'']+)''|([^\s"''>]+))[^>]*>(.*?)</a\s*>', 1), regexp_extract(x, '(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]+)"|''([^'']+)''|([^\s"''>]+))[^>]*>(.*?)</a\s*>', 2), regexp_extract(x, '(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]+)"|''([^'']+)''|([^\s"''>]+))[^>]*>(.*?)</a\s*>', 3)))) AS href,
        unnest(list_transform(m, lambda x: regexp_extract(x, '(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]+)"|''([^'']+)''|([^\s"''>]+))[^>]*>(.*?)</a\s*>', 4))) AS title
      FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]+)"|''([^'']+)''|([^\s"''>]+))[^>]*>(.*?)</a\s*>') AS m FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(html, 'href="(/[a-z]+)"', 'href=\1', 'g') WHEN page_id % 2 = 1 THEN regexp_replace(html, 'href="(/[a-z]+)"', 'href=''\1''', 'g') ELSE html END AS html FROM pages) AS h) AS a
    ) AS b
  ) AS c WHERE first_id <> ''
) AS d WHERE r = 1""")
def extract_links_quoting(spark, sf):
    """The same with addresses in single quotes on odd pages and without quotes on every third."""
    pages = text_table(spark, sf, "pages").withColumn("html", F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", 'href="(/[a-z]+)"', "href=$1")).when(
        F.col("page_id") % 2 == 1, F.regexp_replace("html", 'href="(/[a-z]+)"', "href='$1'")).otherwise(F.col("html")))
    links = ex.extract_links(pages, "html", "url", "page_id", path="^/([a-z])([a-z]+)$", query_keys=None, template="/%s%s")
    return links.select("page_id", "first_id", "second_id", "title")


@query("extract_date", r"""
SELECT page_id, coalesce(nullif(regexp_extract(html, '<article><h1>[^<]*?([0-9]+)', 1), ''),
  nullif(regexp_extract(url, '/([0-9]{3})[/.?#]?', 1), ''), '') AS pub_date FROM pages""")
def extract_date(spark, sf):
    both = text_table(spark, sf, "pages")
    first = tx.first_date("html", ["<article><h1>[^<]*?([0-9]+)"])
    second = tx.first_date("url", ["/([0-9]{3})[/.?#]?"])
    return both.select("page_id", F.when(first != "", first).otherwise(second).alias("pub_date"))


@query("first_keyword", """
SELECT doc_id, CASE WHEN contains(text, 'heit') THEN 'heit' WHEN contains(text, 'The') THEN 'The'
  WHEN contains(text, 'ción') THEN 'ción' ELSE 'all' END AS keyword FROM documents""")
def first_keyword(spark, sf):
    return ex.first_keyword(docs(spark, sf), "text", ["heit", "The", "ción"], "all").select("doc_id", "keyword")


@query("parse_jsonp", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
  event_type <> 'error' AS parsed_ok FROM events""")
def parse_jsonp(spark, sf):
    good = F.when(F.col("event_type") == "error", "false").otherwise("true")
    wrapped = F.concat(F.lit('cb_1( {"success": '), good, F.lit(', "result": '), F.col("props"), F.lit("} );\n"))
    calls = table(spark, sf, "events").select("event_id", wrapped.alias("body"))
    parsed = ex.parse_jsonp(calls, "body", "success boolean, result struct<k:bigint>")
    return parsed.select("event_id", F.when(F.col("parsed_ok"), F.col("payload.result.k")).alias("k"), "parsed_ok")


@query("flatten_payload", """
SELECT user_id, comment_id, comment_at, text_raw, like_count, dislike_count, comment_total FROM (
  SELECT user_id, CAST(k AS VARCHAR) AS comment_id, strftime(ts, '%Y-%m-%d') AS comment_at, 'a & b' AS text_raw,
    k AS like_count, CAST(0 AS BIGINT) AS dislike_count, CASE WHEN k % 3 = 0 THEN 7 ELSE k END AS comment_total,
    row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) AS r
  FROM (SELECT user_id, event_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) AS e WHERE k <> 0
) AS q WHERE r = 1""")
def flatten_payload(spark, sf):
    k = F.get_json_object("props", "$.k")
    number = k.cast("bigint")
    item = F.concat(
        F.lit('{"commentNo": "'), F.when(number == 0, "").otherwise(k), F.lit('", "regTime": "", "modTime": "'),
        F.date_format("ts", "yyyy-MM-dd"), F.lit('", "contents": " a &amp;  b ", "sympathyCount": '), k,
        F.lit('}'))
    count = F.when(number % 3 == 0, F.lit('{"comment": 0, "total": 0}')).otherwise(
        F.concat(F.lit('{"comment": '), k, F.lit("}")))
    body = F.concat(F.lit('{"commentList": ['), item, F.lit(", "), item, F.lit('], "pageModel": {"totalRows": 7}, "count": '),
                    count, F.lit("}"))
    pages = table(spark, sf, "events").select("user_id", "event_id", F.from_json(body, ex.PAYLOAD).alias("payload"))
    return ex.flatten_comments(pages, "payload", "user_id", "event_id")


@query("comment_day", """
SELECT event_id, strftime(ts, '%Y%m%d') AS comment_day FROM events""")
def comment_day(spark, sf):
    return ex.comment_day(table(spark, sf, "events"), "ts").select("event_id", "comment_day")


CASCADE = f"""
pol AS (SELECT d.*, e.ts FROM documents AS d JOIN events AS e ON e.event_id = d.doc_id WHERE regexp_matches(text, '\\S') AND NOT {FLAG}),
{KEEP.replace("FROM documents", "FROM pol").strip()},
clean AS (SELECT * FROM kept WHERE keep),
{HITS.replace("FROM documents", "FROM clean").strip()},
probs AS (
  SELECT ts, weight, pos / (pos + neg + 1.0) AS p_pos, neg / (pos + neg + 1.0) AS p_neg
  FROM (SELECT doc_id, ts, weight, len(regexp_extract_all(clean.text, '(?i)(?:tion)|(?:heit)'))::DOUBLE AS pos,
               len(regexp_extract_all(clean.text, '(?i)(?:ing)|(?:eau)'))::DOUBLE AS neg
        FROM clean JOIN scored USING (doc_id) JOIN (SELECT doc_id, ts FROM pol) AS p USING (doc_id)
        WHERE core_hits * 10 + support_hits * 3 >= 90 AND core_hits > 0) AS q)"""


@query("cascade_daily", """
SELECT CAST(ts + INTERVAL 9 HOUR AS DATE) AS date, count(*) AS comment_count, sum(weight) AS weight_sum,
  sum((p_pos - p_neg) / (p_pos + p_neg + 1e-8) * weight) / (sum(weight) + 1e-8) AS sent_norm_w,
  sum(p_pos * weight) / (sum(weight) + 1e-8) AS pos_mean_w, sum(p_neg * weight) / (sum(weight) + 1e-8) AS neg_mean_w
FROM probs GROUP BY 1""", doubles="weight_sum sent_norm_w pos_mean_w neg_mean_w", with_=f"WITH {CASCADE}")
def cascade_daily(spark, sf):
    """Documents as comments of the events with their number: political, toxic, topical, scored, by day."""
    dated = docs(spark, sf).join(table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), "ts"), "doc_id")
    daily = cascade.comment_cascade(
        dated, cl.lexicon_scorer(["tion", "heit"], ["ing", "eau"]), "text", "doc_id", "ts", "lang", PATTERNS, SEEDS, 0.2, 90,
        categories=CATEGORIES)
    return daily.select("date", "comment_count", "weight_sum", "sent_norm_w", "pos_mean_w", "neg_mean_w")


@query("stage_report", f"""
SELECT lang, count(*) AS total, count(*) FILTER (WHERE {FLAG}) AS political, count(*) FILTER (WHERE NOT keep) AS toxic,
  (SELECT string_agg(w || '=' || n, ';' ORDER BY n DESC, w) FROM (
     SELECT w, count(*) AS n FROM (SELECT lang AS l, unnest(list_filter({_WORDS}, lambda w: contains(lower(text), lower(w)))) AS w FROM kept) AS a
     WHERE l = k.lang GROUP BY w) AS b) AS words,
  (SELECT string_agg(w || '=' || n, ';' ORDER BY n DESC, w) FROM (
     SELECT w, count(*) AS n FROM (SELECT lang AS l, unnest(string_split(toxicity_reason, '|')) AS w FROM kept WHERE toxicity_reason <> '') AS a
     WHERE l = k.lang GROUP BY w) AS b) AS reasons
FROM kept AS k WHERE filled GROUP BY lang""", with_=f"WITH {KEEP}")
def stage_report(spark, sf):
    def flat(name):
        return F.array_join(F.transform(name, lambda s: F.concat_ws("=", s["name"], s["n"].cast("string"))), ";").alias(name)

    report = cascade.stage_report(docs(spark, sf), "lang", "text", PATTERNS, categories=CATEGORIES)
    return report.select("lang", "total", "political", "toxic", flat("words"), flat("reasons"))
