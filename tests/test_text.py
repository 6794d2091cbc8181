"""Edge cases of the text operators."""

from __future__ import annotations

import html
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from moodloom.functions import text as tx
from moodloom.operators import classify as cl
from moodloom.operators import extract as ex
from moodloom.operators import joining as jn


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id int, text string")


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_unescape(spark):
    values = ["a &amp;lt; b", "&#65;&#x42;&#x1F600;", "&notanentity; &copy &copy;", "&#0;&#xD800;&#128;", "x & y && &", "&nbsp;|&hellip;",
              "&ampx &notit;", ""]
    assert column(texts(spark, values).select("id", tx.unescape("text").alias("t")), "t") == [html.unescape(v) for v in values]


def test_normalize_space(spark):
    values = ["  a\n\t b  ", None, "x&nbsp;&nbsp;y", "   "]
    assert column(texts(spark, values).select("id", tx.normalize_space("text").alias("t")), "t") == ["a b", "", "x y", ""]
    assert column(texts(spark, values).select("id", tx.has_text("text").alias("t")), "t") == [True, False, True, False]


def test_absolute_url(spark):
    base = "https://example.org/a/b/c.html?q=1#f"
    links = ["/x/y", "z.html", "../up", "../../../top/./k", "//other.org/p", "http://q.org/", "?page=2", "#here", "./same/", "d/../e?x=../y"]
    got = column(texts(spark, links).select("id", tx.absolute_url("text", F.lit(base)).alias("t")), "t")
    assert got == [urljoin(base, link) for link in links]


def test_ids(spark):
    urls = ["https://n.example.org/mnews/article/001/0123456789?x=1", "https://e.org/read?oid=015&aid=0000000042", "https://e.org/read?oid=15&aid=1", "no"]
    out = ex.extract_ids(texts(spark, urls), "text", template="u/%s/%s")
    assert column(out, "canonical") == ["u/001/0123456789", "u/015/0000000042", None, None]


def test_links_prefer_styled(spark):
    art = "/article/001/000000000"
    styled = f'<a class="k" href="{art}1"><div><strong class="sa_text_strong">One &amp; <b>two</b></strong></div></a><a href="{art}9">plain</a>'
    plain = f'<a href="{art}2">first</a> <a href="{art}2">again</a><a href="/other">no</a>'
    pages = spark.createDataFrame([(1, styled), (2, plain)], "id int, html string").withColumn("url", F.lit("https://e.org/list"))
    rows = {(r["id"], r["second_id"], r["title"]) for r in ex.extract_links(pages, "html", "url", "id").collect()}
    assert rows == {(1, "0000000001", "One & two"), (2, "0000000002", "first")}


def test_political_flags(spark):
    df = texts(spark, ["MB 이야기", "국회 소식", "시장", None])
    assert column(cl.flag_patterns(df, "text"), "is_political") == [False, True, False, False]
    assert column(cl.match_keywords(df, "text"), "matched_keywords") == [["MB"], ["국회"], [], []]


def test_lexicon(spark):
    df = texts(spark, ["병신", "아주 긴 글 병신 새끼", "보지 틀딱 병신 새끼 한남", "", None, "맑음"])
    out = cl.lexicon_toxicity(df, "text")
    assert column(out, "toxicity_score") == pytest.approx([0.65, 0.67, 1.0, 1.0, 1.0, 0.0])
    assert column(out, "toxicity_reason") == ["direct_abuse", "direct_abuse", "direct_abuse|hate_slur|sexual", "empty", "empty", ""]
    weighted = cl.toxicity_weight(out, "text")
    assert column(weighted, "weight") == pytest.approx([0.1225, 0.1089, 0.0, 0.0, 0.0, 1.0])
    assert column(weighted, "keep") == [True, True, False, False, False, True]


def test_nested_words_count_twice(spark):
    df = texts(spark, ["주식시장이 좋다", "금리"])
    vocab = spark.createDataFrame([("주식", "core"), ("주식시장", "core"), ("금리", "support")], "token string, kind string")
    out = cl.score_relevance(df, "text", vocab, "id")
    assert column(out, "stock_score") == [20, 3]
    assert column(out, "is_stock") == ["stock", "other"]


def test_word_lists_beyond_the_bound(spark, monkeypatch):
    words = [f"w{i:03d}" for i in range(300)]
    vocab = spark.createDataFrame([(w, i % 2, g) for i, w in enumerate(words) for g in ("x", None)], "token string, class int, g string")
    rows = [("x" if i % 3 else None, " ".join(words[i:i + 40]).upper() + "!", {"a": 1}) for i in range(0, 280, 20)] + [("x", "none", None), ("y", "w001", None)]
    df = spark.createDataFrame(rows * 2, "g string, text string, m map<string, int>")
    near = cl.word_hits(df, "text", vocab, 2, "g").collect()
    monkeypatch.setattr(jn, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(jn.bounded_join, "__defaults__", ("left", 1, False))
    far = cl.word_hits(df, "text", vocab, 2, "g").collect()
    assert len(near) == len(far) == 2 * len(rows)
    assert sorted(map(str, near)) == sorted(map(str, far))
    assert sorted({tuple(r["hits"]) for r in near}) == [(0, 0), (20, 20)]


def test_word_hits_inside_words(spark):
    vocab = spark.createDataFrame([("ab", 0), ("bc", 1), ("abc", 1), ("é", 0)], "token string, class int")
    df = texts(spark, ["xABCx ab", "a b c", "É.bc", ""])
    assert column(cl.word_hits(df, "text", vocab, 2), "hits") == [[1, 2], [0, 0], [1, 1], [0, 0]]


def test_bounded_join_beyond_the_bound(spark):
    key = F.when(F.col("id") % 7 < 6, (F.col("id") % 7).cast("int"))
    big = spark.range(5000).select((F.col("id") % 2500).alias("id"), key.alias("k"), F.create_map(F.lit("a"), F.col("id") % 3).alias("m"))
    small = spark.createDataFrame([(i, i * 10) for i in range(5)] + [(None, -1)], "k int, v int")
    for how in ("left", "inner", "left_anti"):
        near, far = (jn.bounded_join(big, small, ["k"], how, max_bytes=m) for m in (1 << 20, 1))
        assert sorted(map(str, near.collect())) == sorted(map(str, far.select(near.columns).collect()))
    assert jn.bounded_join(big, small, ["k"], "inner", max_bytes=1).count() == 5000 - big.where("k = 5").count()


def test_sentiment_ties(spark):
    df = spark.createDataFrame([(0, 0.4, 0.2, 0.4), (1, 0.4, 0.4, 0.2), (2, 0.6, 0.2, 0.2)], "id int, p_pos double, p_neu double, p_neg double")
    assert column(cl.sentiment_columns(df), "sentiment_label") == ["neg", "neu", "pos"]


def test_list_text(spark):
    df = texts(spark, ["['a', \"b'c\"]", "[]"])
    assert [r["item"] for r in cl.decode_list_text(df, "text").collect()] == ["a", "b'c"]


def test_word_hits_of_short_long_and_joined_lists(spark):
    rows = [(1, "a", "Über xyÜberz ABAB"), (2, "a", None), (3, None, "abc abcd \tabc"), (4, "b", "nothing"), (5, "a", " "), (6, "a", "ας İx 😀😀z"),
            (7, None, "q" * 500 + "abcd"), (1, "a", "Über xyÜberz ABAB"), (8, "a", "bcdefghij"), (9, "a", "ab cd efgh")]
    listed = [("a", "über", 0), ("a", "ab", 1), ("a", "ba", 1), ("a", "ab", 0), ("a", "ab", 0), ("a", "ας", 2), ("a", "😀z", 0), (None, "abcd", 0),
              (None, "c a", 1), (None, None, 1), ("a", "", 2), ("a", "zz", None), ("a", "cdef", 0), ("a", "cdefghij", 1), ("a", "b cd", 1)]
    df = spark.createDataFrame(rows, "id long, lang string, text string")
    vocab = spark.createDataFrame(listed, "lang string, token string, class int")
    many = spark.createDataFrame([("a", f"{a}{b}{c}{d}", 0) for a in "wvy" for b in "wvy" for c in "0123456789" for d in "0123"], vocab.schema)
    for words in (vocab, vocab.union(many), vocab.limit(0)):
        for by in ("lang", None):
            lists = {}
            for lang, token, kind in words.collect():
                if token is not None and kind is not None and " " not in token:
                    lists.setdefault(lang if by else 0, set()).add((token, kind))
            want = sorted((i, [sum(k == c and w in (t or "").lower() and bool((t or "").strip()) for w, k in lists.get(lang if by else 0, ()))
                               for c in range(3)]) for i, lang, t in rows)
            for most in (cl.MOST_WORDS, -1):
                got = cl.word_hits(df, "text", words, 3, by, most=most)
                assert got.columns == [*df.columns, "hits"]
                assert sorted((r.id, r.hits) for r in got.collect()) == want


def test_word_hits_read_each_text_once(spark):
    """No substrings per row and length, and a filter on the counts does not count again."""
    df = spark.createDataFrame([(1, "a", "abcd")], "id long, lang string, text string")
    vocab = spark.createDataFrame([("a", "abcd", 0)], "lang string, token string, class int")
    plan = cl.word_hits(df, "text", vocab, 1, "lang").where("hits[0] > 0")._jdf.queryExecution().executedPlan().toString()
    assert "substring" not in plan and plan.count("ArrowEvalPython") == 1
