"""From raw pages and payloads to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.columns import computed_once, names
from ..functions.fixed_values import ARTICLE_PATH, DATE_PATTERNS, HEADLINE_LINK

# Quoted either way or bare; the groups of the three are alternatives.
ANCHOR = r"""(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]+)"|'([^']+)'|([^\s"'>]+))[^>]*>(.*?)</a\s*>"""
TITLE_ATTRIBUTE = r"""(?is)^<a\b[^>]*?\stitle\s*=\s*(?:"([^"]+)"|'([^']+)')"""


def extract_ids(df: DataFrame, url: str, path: str = ARTICLE_PATH, query_keys: tuple[str, str] | None = ("oid", "aid"),
                template: str | None = None, query_shapes: tuple[str, str] = (r"^\d{3}$", r"^\d{10}$")) -> DataFrame:
    """Add the two ids of an address and, if a template is given, its canonical form."""
    found = df.withColumn("_ids", tx.ids_from_url(url, path, query_keys, query_shapes))
    found = found.withColumns({"first_id": F.col("_ids.first_id"), "second_id": F.col("_ids.second_id")}).drop("_ids")
    if template:
        found = found.withColumn("canonical", canonical_url("first_id", "second_id", template))
    return found


def canonical_url(first: str, second: str, template: str) -> Column:
    """Fill a template with two `%s` places; NULL where an id is missing."""
    return F.when(F.col(first).isNotNull(), F.format_string(template, F.col(first), F.col(second)))


def extract_links(df: DataFrame, html: str, url: str, key: str | Sequence[str], styled: str = HEADLINE_LINK,
                  path: str = ARTICLE_PATH, query_keys: tuple[str, str] | None = ("oid", "aid"),
                  template: str = "%s/%s") -> DataFrame:
    """Links of each page that carry ids, once per id pair, in page order.

    Styled headline links are used where the page has any; otherwise every anchor counts, whichever way its address is
    quoted. An anchor without text has the text of its `title` attribute. Everything happens inside the page's row:
    nothing is shuffled.
    """
    keys = names(key)
    patterns = [p if p.startswith("(?") else f"(?s){p}" for p in (styled, ANCHOR)]

    def matches(style: int) -> Column:
        groups = [1] if style == 0 else [1, 2, 3]
        last = 2 if style == 0 else 4

        def parts(m: Column, i: Column) -> Column:
            return F.struct(i.alias("position"), F.concat(*[F.regexp_extract(m, patterns[style], g) for g in groups]).alias("href"),
                            tx.strip_tags(F.regexp_extract(m, patterns[style], last)).alias("own"), m.alias("whole"))

        def link(x: Column) -> Column:
            ids = tx.ids_from_url(tx.absolute_url(tx.unescape(x["href"]), F.col(url)), path, query_keys)
            named = tx.normalize_space(F.concat(*[F.regexp_extract(x["whole"], TITLE_ATTRIBUTE, g) for g in (1, 2)]))
            return F.struct(ids.alias("ids"), x["position"].alias("position"),
                            F.when(x["own"] == "", named).otherwise(x["own"]).alias("title"))

        whole = F.regexp_extract_all(F.col(html), F.lit(patterns[style]), F.lit(0))
        links = F.transform(F.transform(whole, parts), link)
        return F.array_sort(F.filter(links, lambda x: x["ids"].isNotNull()))

    # Each step is a column of its own: named inside a lambda, a list would be built anew for each of its elements.
    found = computed_once(df, {"_styled": matches(0)})
    found = computed_once(found, {"_links": F.when(F.size("_styled") > 0, F.col("_styled")).otherwise(matches(1))})
    # Sorted by ids and position, so the first of each pair of ids follows a link with other ids.
    best = F.filter("_links", lambda x, i: (i == 0) | ~F.get("_links", F.greatest(i - 1, F.lit(0)))["ids"].eqNullSafe(x["ids"]))
    both = found.select(*keys, best.alias("_best"))
    rows = both.select(*keys, F.explode("_best").alias("_m"))
    return rows.select(*keys, F.col("_m.position").alias("position"), F.col("_m.ids.first_id").alias("first_id"),
                       F.col("_m.ids.second_id").alias("second_id"),
                       F.format_string(template, "_m.ids.first_id", "_m.ids.second_id").alias("canonical"),
                       F.col("_m.title").alias("title"))


def normalize_space(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    return df.withColumn(name or column, tx.normalize_space(column))


def strip_tags(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    return df.withColumn(name or column, tx.strip_tags(column))


def first_keyword(df: DataFrame, column: str, words: Sequence[str], default: str = "",
                  name: str = "keyword") -> DataFrame:
    return df.withColumn(name, tx.first_keyword(column, words, default))


def extract_first_of(df: DataFrame, page: str, patterns: Sequence[str] = tuple(DATE_PATTERNS),
                     name: str = "pub_date") -> DataFrame:
    """Digits of the first ordered date pattern that the page matches, '' if none does."""
    return df.withColumn(name, tx.first_date(page, patterns))


def comment_day(df: DataFrame, column: str, name: str = "comment_day") -> DataFrame:
    return df.withColumn(name, tx.leading_day(column))


def parse_jsonp(df: DataFrame, column: str, schema: str, name: str = "payload",
                success: str | None = "success") -> DataFrame:
    """Unwrap a callback, parse its JSON and mark rows that failed, keeping their text aside."""
    parsed = df.withColumn(name, F.from_json(tx.unwrap_call(column), schema))
    good = F.col(name).isNotNull()
    if success:
        good = good & F.coalesce(F.col(f"{name}.{success}"), F.lit(False))
    return parsed.withColumn("parsed_ok", good).withColumn("quarantine", F.when(~F.col("parsed_ok"), F.col(column)))


PAYLOAD = (
    "commentList array<struct<commentNo:string, regTime:string, modTime:string, contents:string,"
    " sympathyCount:bigint, antipathyCount:bigint>>,"
    " count struct<comment:bigint, total:bigint>, pageModel struct<totalRows:bigint>"
)


def _first_filled(*values: Column) -> Column:
    """First value that is neither missing nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def _first_nonzero(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit(0).cast("bigint")) for v in values], F.lit(0).cast("bigint"))


def flatten_comments(df: DataFrame, payload: str, key: str | Sequence[str], order: str | None = None) -> DataFrame:
    """Comments of parsed payloads: one row per article and comment id, the first one winning.

    The expected total of the article is added; it falls back over the alternative counters.
    """
    keys = names(key)
    rows = df.select(*keys, *names(order), F.posexplode(f"{payload}.commentList").alias("_pos", "_c"),
                     _first_nonzero(F.col(f"{payload}.count.comment"), F.col(f"{payload}.count.total"),
                                    F.col(f"{payload}.pageModel.totalRows")).alias("comment_total"))
    rows = rows.withColumn("comment_id", _first_filled(F.col("_c.commentNo"))).where(F.col("comment_id") != "")
    value = F.struct(
        *[F.col(o) for o in names(order)], "_pos",
        _first_filled(F.col("_c.regTime"), F.col("_c.modTime")).alias("comment_at"),
        F.col("_c.contents").alias("_raw"),
        _first_nonzero(F.col("_c.sympathyCount")).alias("like_count"),
        _first_nonzero(F.col("_c.antipathyCount")).alias("dislike_count"),
        "comment_total")
    single = rows.groupBy(*keys, "comment_id").agg(F.min(value).alias("_v"))
    return single.select(*keys, "comment_id", "_v.comment_at", tx.normalize_space("_v._raw").alias("text_raw"),
                         "_v.like_count", "_v.dislike_count", "_v.comment_total")
