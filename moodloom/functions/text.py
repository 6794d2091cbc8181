"""Column expressions over text: cleaning, ids, links and pattern matches, all evaluated in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnLike, col, flag, grid  # noqa: F401
from .fixed_values import DATE_PATTERNS, token_pattern

# White space as Unicode defines it, not only the ASCII part.
WHITE = r"\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Frequent names first: a lookup stops at the first hit.
_COMMON = ["amp;", "quot;", "lt;", "gt;", "nbsp;", "apos;", "middot;", "copy;", "hellip;"]
_NAMED = {name: html5[name] for name in [*_COMMON, *html5] if name.endswith(";")}
_BARE = sorted((name for name in html5 if not name.endswith(";")), key=len, reverse=True)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Use a value several times but compute it once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _literal_map(table: dict[str, str]) -> Column:
    """Map from two split literals, which the optimizer folds into a single constant."""
    return F.map_from_arrays(F.split(F.lit("\u0001".join(table)), "\u0001"),
                             F.split(F.lit("\u0001".join(table.values())), "\u0001"))


def _latin1_controls() -> dict[int, str]:
    """Code points 0x80-0x9f are read as windows-1252, as browsers do."""
    table = {}
    for code in range(0x80, 0xA0):
        try:
            table[code] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            table[code] = chr(code)
    return table


def _code_point(number: Column) -> Column:
    """Character of a code point; impossible ones become the replacement character."""
    from_table = F.try_element_at(
        F.create_map(*[F.lit(p) for pair in _latin1_controls().items() for p in pair]), number.cast("int")
    )
    encoded = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    bad = number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    return F.when(bad, F.lit("�")).when(number.between(0x80, 0x9F), from_table).otherwise(encoded)


def unescape(text: ColumnLike) -> Column:
    """Resolve HTML entities in one pass: split at '&', then resolve the start of each piece."""
    named = _literal_map(_NAMED)
    bare = _literal_map({n: html5[n] for n in _BARE})

    def resolve(piece: Column) -> Column:
        decimal = F.regexp_extract(piece, r"^#([0-9]+);?", 1)
        hexa = F.regexp_extract(piece, r"^#[xX]([0-9a-fA-F]+);?", 1)
        name = F.regexp_extract(piece, r"^[A-Za-z][A-Za-z0-9]*;", 0)
        short = F.regexp_extract(piece, "^(?:" + "|".join(_BARE) + ")", 0)
        return (
            F.when(decimal != "", F.concat(
                _code_point(decimal.try_cast("bigint")), F.regexp_replace(piece, r"^#[0-9]+;?", "")))
            .when(hexa != "", F.concat(
                _code_point(F.when(F.length(hexa) <= 12, F.conv(hexa, 16, 10).try_cast("bigint"))),
                F.regexp_replace(piece, r"^#[xX][0-9a-fA-F]+;?", "")))
            .when((name != "") & F.try_element_at(named, name).isNotNull(),
                  F.concat(F.try_element_at(named, name), F.substr(piece, F.length(name) + 1)))
            .when(short != "", F.concat(F.try_element_at(bare, short), F.substr(piece, F.length(short) + 1)))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    value = col(text)
    pieces = F.split(value, "&")
    resolved = F.concat(
        F.element_at(pieces, 1),
        F.array_join(F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), resolve), ""),
    )
    return F.when(F.contains(value, F.lit("&")), resolved).otherwise(value)


def squeeze(text: ColumnLike) -> Column:
    """Runs of white space become one blank; ends are trimmed; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), f"[{WHITE}]+", " "))


def normalize_space(text: ColumnLike) -> Column:
    return squeeze(unescape(F.coalesce(col(text), F.lit(""))))


def strip_tags(html: ColumnLike) -> Column:
    return normalize_space(F.regexp_replace(col(html), "<[^>]+>", " "))


def has_text(text: ColumnLike) -> Column:
    """At least one character that is not white space."""
    return flag(F.rlike(col(text), F.lit(f"[^{WHITE}]")))


def any_of(patterns: Sequence[str], ignore_case: bool = False) -> str:
    joined = "|".join(f"(?:{p})" for p in patterns)
    return f"(?iu){joined}" if ignore_case else joined


def alternatives(patterns: Sequence[str]) -> list[str]:
    """The words of alternation patterns, unique and sorted."""
    return sorted({word for pattern in patterns for word in pattern.split("|")})


def first_keyword(text: ColumnLike, words: Sequence[str], default: str = "") -> Column:
    """First listed word that the text contains."""
    value = col(text)
    return F.coalesce(*[F.when(F.contains(value, F.lit(w)), F.lit(w)) for w in words], F.lit(default))


def first_date(page: ColumnLike, patterns: Sequence[str] = tuple(DATE_PATTERNS)) -> Column:
    """Digits of the first ordered pattern that matches, '' if none does."""
    value = col(page)
    tried = []
    for pattern in patterns:
        groups = re.compile(pattern).groups
        digits = F.concat(*[F.regexp_extract(value, pattern, g) for g in range(1, groups + 1)])
        tried.append(F.nullif(F.regexp_replace(digits, "-", ""), F.lit("")))
    return F.coalesce(*tried, F.lit(""))


def leading_day(stamp: ColumnLike) -> Column:
    """yyyymmdd of a text that starts with yyyy-mm-dd, '' otherwise."""
    day = F.regexp_extract(F.coalesce(col(stamp).cast("string"), F.lit("")), r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.regexp_replace(day, "-", "")


def ids_from_url(url: ColumnLike, path_pattern: str, query_keys: tuple[str, str] | None = None,
                 query_shapes: tuple[str, str] = (r"^\d{3}$", r"^\d{10}$")) -> Column:
    """Pair of ids from the path, else from two query parameters, else NULL."""
    def pair(first: Column, second: Column) -> Column:
        return F.struct(first.alias("first_id"), second.alias("second_id"))

    def ids(link: Column) -> Column:
        path = F.regexp_extract(link, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
        first, second = F.regexp_extract(path, path_pattern, 1), F.regexp_extract(path, path_pattern, 2)
        found = F.when(first != "", pair(first, second))
        if query_keys is None:
            return found
        query = F.regexp_extract(link, r"\?([^#]*)", 1)
        values = [F.regexp_extract(query, rf"(?:^|&){re.escape(key)}=([^&]+)", 1) for key in query_keys]
        shaped = F.rlike(values[0], F.lit(query_shapes[0])) & F.rlike(values[1], F.lit(query_shapes[1]))
        return F.coalesce(found, F.when(shaped, pair(*values)))

    return let(unescape(url), ids)


def _tidy_path(path: Column) -> Column:
    """Resolve `.` and `..` parts."""
    kept = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda acc, part: F.when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(part == ".", acc).otherwise(F.array_append(acc, part)),
    )
    ends_open = F.rlike(path, F.lit(r"/\.\.?$"))
    return F.concat(F.array_join(kept, "/"), F.when(ends_open, F.lit("/")).otherwise(F.lit("")))


def absolute_url(link: ColumnLike, base: ColumnLike) -> Column:
    """Resolve a link against the address of its page."""
    page = col(base)
    scheme = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    host = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    bare = F.regexp_extract(page, r"^([^?#]*)", 1)
    folder = F.regexp_replace(F.substr(bare, F.length(host) + 1), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)

    def resolve(href: Column) -> Column:
        path = F.regexp_extract(href, r"^([^?#]*)", 1)
        tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
        return (
            F.when(F.rlike(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), href)
            .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
            .when(F.startswith(href, F.lit("/")), F.concat(host, _tidy_path(path), tail))
            .when(href == "", page)
            .when(F.startswith(href, F.lit("?")), F.concat(bare, href))
            .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_extract(page, r"^([^#]*)", 1), href))
            .otherwise(F.concat(host, _tidy_path(F.concat(folder, path)), tail))
        )

    return let(col(link), resolve)


def unwrap_call(text: ColumnLike) -> Column:
    """Inside of `name( ... );`, or the text itself when it is not wrapped."""
    value = col(text)
    inner = F.regexp_extract(value, r"(?s)^[^(]*\((.*)\)\s*;?\s*$", 1)
    wrapped = F.rlike(value, F.lit(r"(?s)^[^(]*\(.*\)\s*;?\s*$"))
    return F.when(wrapped, inner).otherwise(value)


def tokens(text: ColumnLike, pattern: str | None = None) -> Column:
    """All tokens of the lowercased text, repeats included."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(pattern or token_pattern()), F.lit(0))


def matched_words(text: ColumnLike, words: Sequence[str]) -> Column:
    """Listed words found anywhere in the text, whatever the case, in list order."""
    low = F.lower(col(text))
    pairs = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(w.lower()).alias("low")) for w in words])
    hits = F.transform(F.filter(pairs, lambda p: F.contains(low, p["low"])), lambda p: p["word"])
    return F.coalesce(hits, F.array().cast("array<string>"))


def list_items(text: ColumnLike) -> Column:
    """Items of a list written as text with quoted items."""
    found = F.regexp_extract_all(col(text), F.lit("'([^']+)'|\"([^\"]+)\""), F.lit(0))
    return F.transform(found, lambda item: F.substr(item, F.lit(2), F.length(item) - 2))
