"""Text classification: pattern flags, toxicity weights, corpus vocabulary and relevance scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..functions.columns import clip, computed_once, flag, names
from ..session import settle
from .joining import bounded_join

DOCUMENT = "\u0000document"
#: Words that go to the tasks as a whole, and words that are looked for one by one.
MOST_WORDS, FEW_WORDS = 200_000, 256
WHITE = " \t\n\x0b\f\r"


def flag_patterns(df: DataFrame, column: str, patterns: Sequence[str] = tuple(fv.POLITICAL_PATTERNS),
                  name: str = "is_political") -> DataFrame:
    """Does any pattern occur in the lowercased text. Patterns are used as written, so one with
    capital letters never matches."""
    return df.withColumn(name, flag(F.rlike(F.lower(F.col(column)), F.lit(tx.any_of(patterns)))))


def match_keywords(df: DataFrame, column: str, patterns: Sequence[str] = tuple(fv.POLITICAL_PATTERNS),
                   name: str = "matched_keywords", count: str = "keyword_count") -> DataFrame:
    """Sorted list of the words found, whatever their case, and its length."""
    found = df.withColumn(name, tx.matched_words(column, tx.alternatives(patterns)))
    return found.withColumn(count, F.size(name))


def lexicon_toxicity(df: DataFrame, column: str, categories: Mapping[str, Sequence[str]] | None = None,
                     severity: Mapping[str, float] | None = None, score: str = "toxicity_score",
                     reason: str = "toxicity_reason") -> DataFrame:
    """Score from a lexicon: each category found adds its severity, more for repeats and for very
    short texts; at most 1. An empty text scores 1 with reason `empty`."""
    categories = fv.TOXIC_CATEGORIES if categories is None else categories
    severity = fv.TOXIC_SEVERITY if severity is None else severity
    text = F.col(column)
    counts = {c: F.regexp_count(text, F.lit(tx.any_of(p, ignore_case=True))) for c, p in categories.items()}
    counted = computed_once(df, {f"_n_{c}": n for c, n in counts.items()})
    total = F.lit(0.0)
    for c in categories:
        n = F.col(f"_n_{c}")
        total = total + F.when(n >= 2, severity[c] + fv.TOXIC_REPEAT_BONUS).when(n == 1, severity[c]).otherwise(0.0)
    short = F.length(text) <= fv.TOXIC_SHORT_LENGTH
    raised = total + F.when(short & (total > 0), fv.TOXIC_SHORT_BONUS).otherwise(0.0)
    reasons = F.array_compact(F.array(*[F.when(F.col(f"_n_{c}") > 0, F.lit(c)) for c in categories]))
    filled = tx.has_text(column)
    return counted.withColumns({
        score: F.when(filled, F.least(raised, F.lit(1.0))).otherwise(1.0),
        reason: F.when(filled, F.array_join(reasons, "|")).otherwise("empty"),
    }).drop(*[f"_n_{c}" for c in categories])


def toxicity_weight(df: DataFrame, column: str, score: str = "toxicity_score", gamma: float = fv.GAMMA,
                    hard_tau: float = fv.HARD_TAU, mode: str = "weight", tau: float = fv.TAU,
                    model: bool = False) -> DataFrame:
    """Weight and keep flag of a text. With `model` the score comes from a model: missing means 0 and
    an empty text scores 0."""
    if mode not in ("weight", "drop"):
        raise ValueError("mode must be 'weight' or 'drop'")
    marked = df.withColumn("is_empty", ~tx.has_text(column))
    value = F.col(score)
    if model:
        value = F.when(F.col("is_empty"), 0.0).otherwise(F.coalesce(value, F.lit(0.0)))
    marked = marked.withColumn(score, clip(value.cast("double"), 0.0, 1.0))
    kept = ~F.col("is_empty")
    if mode == "drop":
        return marked.withColumns({"weight": F.lit(1.0), "keep": kept & (F.col(score) < tau)})
    return marked.withColumns({
        "weight": F.when(F.col("is_empty"), 0.0).otherwise(weight_of(F.col(score), gamma)),
        "keep": kept & (F.col(score) < hard_tau)})


def weight_of(score: Column, gamma: float | Column) -> Column:
    return F.pow(clip(1.0 - score, 0.0), F.lit(gamma) if not isinstance(gamma, Column) else gamma)


def token_counts(df: DataFrame, column: str, by: str | Sequence[str] | None = None,
                 pattern: str | None = None) -> DataFrame:
    """Number of documents per token and group, in one pass over the text.

    A marker token counts the documents themselves. Counts are summed per task before the shuffle,
    which then carries distinct (group, token) pairs, so no group lands in one task. The result is
    kept, as several readers follow.
    """
    keys = names(by)
    words = F.array_append(F.array_distinct(tx.tokens(column, pattern)), F.lit(DOCUMENT))
    rows = tx_filter(df, column).select(*keys, F.explode(words).alias("token"))
    return settle(rows.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("doc_count")))


def tx_filter(df: DataFrame, column: str) -> DataFrame:
    return df.where(tx.has_text(column))


def vocabulary(counts: DataFrame, seeds: Sequence[str] = tuple(fv.MARKET_SEEDS),
               min_ratio: float = fv.MIN_DOC_RATIO, band: float = fv.SUPPORT_BAND,
               by: str | Sequence[str] | None = None) -> DataFrame:
    """Core and support words from token counts.

    A word needs at least min_ratio * band of the documents of its group, so a group has at most
    (mean distinct words per document) / (min_ratio * band) of them, whatever the corpus size.
    """
    keys = names(by)
    totals = counts.where(F.col("token") == DOCUMENT).select(*keys, F.col("doc_count").alias("documents"))
    words = counts.where((F.col("token") != DOCUMENT) & F.rlike("token", F.lit(tx.any_of(seeds))))
    if keys:
        joined = bounded_join(words, totals, keys, "inner", settled=True)
    else:
        joined = words.withColumn("documents", totals.select("documents").scalar())
    threshold = F.col("documents") * F.lit(min_ratio)
    kind = F.when(F.col("doc_count") >= threshold, "core").when(
        F.col("doc_count") >= threshold * F.lit(band), "support")
    return joined.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        *keys, "token", "kind", "doc_count", (100.0 * F.col("doc_count") / F.col("documents")).alias("pct"))


def keyword_df(df: DataFrame, column: str, token_regex: str | None = None,
               seed_regex: Sequence[str] = tuple(fv.MARKET_SEEDS), by: str | Sequence[str] | None = None,
               min_ratio: float = fv.MIN_DOC_RATIO, band: float = fv.SUPPORT_BAND) -> DataFrame:
    """Core and support vocabulary of a corpus by document frequency."""
    return vocabulary(token_counts(df, column, by, token_regex), seed_regex, min_ratio, band, by)


def word_hits(df: DataFrame, column: str, vocab: DataFrame, classes: int, by: str | Sequence[str] | None = None,
              name: str = "hits", most: int = MOST_WORDS) -> DataFrame:
    """Add how many vocabulary words of each class occur in the text as substrings.

    `vocab` has one row per word (`token`, without white space) and its `class`, 0 to classes - 1. The words of a group
    form one list, found through a size check, so the text stays where it is. A word that occurs lies inside a run of
    characters without white space, which only the rare lists of more than `most` words need: they are joined to the rows, and
    each run is cut into substrings that meet the list of its row. Other lists go to the tasks as a whole (`_Words`).
    """
    keys = names(by)
    lists = [F.collect_list(F.when(F.col("class") == i, F.col("token"))).alias(f"c{i}") for i in range(classes)]
    packed = settle(vocab.groupBy(*keys).agg(F.struct(
        F.collect_list("token").alias("words"), F.array_sort(F.collect_set(F.length("token"))).alias("lengths"),
        *lists).alias("_list")).withColumn("_group", F.monotonically_increasing_id()))
    if (packed.agg(F.sum(F.size("_list.words"))).first()[0] or 0) > most:
        return _joined_hits(df, column, packed.drop("_group"), classes, keys, name)
    words = {r["_group"]: [r[f"c{i}"] for i in range(classes)]
             for r in packed.select("_group", *[f"_list.c{i}" for i in range(classes)]).collect()}
    grouped = bounded_join(df, packed.select(*keys, "_group"), keys, "left", settled=True) if keys else df.withColumn(
        "_group", packed.select("_group").scalar())

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[int, _Words] = {}
        none = [0] * classes
        for groups, texts in batches:
            out = []
            for start in range(0, len(texts), 256):
                for group, text in zip(groups.slice(start, 256).to_pylist(), texts.slice(start, 256).cast(pa.binary()).to_pylist(), strict=True):
                    if group is None or text is None:
                        out.append(none)
                        continue
                    if group not in known:
                        known[group] = _Words(words[group])
                    out.append(known[group].count(text))
            yield pa.array(out, pa.list_(pa.int32()))

    # Not deterministic by name only: a filter on the counts must not run the function a second time.
    hits = F.arrow_udf(run, "array<int>").asNondeterministic()
    return grouped.withColumn(name, hits(F.col("_group"), F.lower(F.col(column)))).drop("_group")


class _Words:
    """Counts the words of a list that occur in a text, per class; both are UTF-8.

    Of a long list, the first four bytes of the words are marked in a table, which tells the places of a text where a word
    may begin; there a table per length, by the first and last four bytes, tells whether a word of this length may stand, and
    what is left is looked up. Shorter words meet the set of the text's parts of their length; where there are few, as in a
    short list, each is looked for in the text.
    """

    START = 4

    def __init__(self, lists: Sequence[Sequence[str]], few: int = FEW_WORDS):
        self.none = [0] * len(lists)
        self.classes: dict[bytes, list[int]] = {}
        for i, listed in enumerate(lists):
            for word in set(listed):
                # White space parts the runs of a text, so no word reaches across; an empty one needs a run.
                if not set(word) & set(WHITE):
                    self.classes.setdefault(word.encode(), []).append(i)
        sizes: dict[int, list[bytes]] = {}
        for word in filter(None, self.classes):
            sizes.setdefault(len(word), []).append(word)
        short = len(self.classes) <= few
        self.plain = [w for n, same in sizes.items() if short or (n < self.START and len(same) <= few) for w in same]
        self.parts = {n: set(same) for n, same in sizes.items() if not short and n < self.START and len(same) > few}
        self.tables = {n: self.marked([w[:self.START] for w in same], [w[-self.START:] for w in same])
                       for n, same in sizes.items() if not short and n >= self.START}
        starts = sorted({w[:self.START] for n in self.tables for w in sizes[n]})
        self.starts = self.marked(starts, starts)

    def marked(self, first: Sequence[bytes], last: Sequence[bytes]) -> tuple[int, np.ndarray]:
        bits = max(12, (16 * len(first)).bit_length())
        table = np.zeros(1 << bits, bool)
        table[self.slots(np.frombuffer(b"".join(first), "<u4"), np.frombuffer(b"".join(last), "<u4"), bits)] = True
        return bits, table

    @staticmethod
    def slots(first: np.ndarray, last: np.ndarray, bits: int) -> np.ndarray:
        return (((first * np.uint32(0x85EBCA6B)) ^ last) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)

    def inside(self, text: bytes) -> set[bytes]:
        found = {w for w in self.plain if w in text}
        for n, listed in self.parts.items():
            found |= listed & {text[i:i + n] for i in range(len(text) - n + 1)}
        if self.tables and len(text) >= self.START:
            codes = np.ndarray(len(text) - self.START + 1, "<u4", text, strides=(1,)).copy()
            bits, table = self.starts
            begin = np.flatnonzero(table[self.slots(codes, codes, bits)])
            first = codes[begin]
            for n, (bits, table) in self.tables.items():
                fits = np.searchsorted(begin, len(text) - n, "right")
                at = begin[:fits]
                hits = at[table[self.slots(first[:fits], codes[at + n - self.START], bits)]]
                found.update(w for w in {text[i:i + n] for i in hits.tolist()} if w in self.classes)
        if b"" in self.classes and text.strip(WHITE.encode()):
            found.add(b"")
        return found

    def count(self, text: bytes) -> list[int]:
        out = self.none.copy()
        for word in self.inside(text):
            for i in self.classes[word]:
                out[i] += 1
        return out


def _joined_hits(df: DataFrame, column: str, packed: DataFrame, classes: int, keys: Sequence[str], name: str) -> DataFrame:
    """The same for lists of any size, which are joined to the rows: the distinct runs are cut into substrings of the
    lengths a list has, and these meet it in one hash lookup each."""
    joined = bounded_join(df, packed, keys, "left", settled=True) if keys else df.withColumn("_list", packed.select("_list").scalar())
    runs = F.array_distinct(F.regexp_extract_all(F.lower(F.col(column)), F.lit(r"\S+"), F.lit(0)))
    none = F.array().cast("array<string>")

    def cuts(run: Column) -> Column:
        return F.flatten(F.transform(F.col("_list.lengths"), lambda n: F.when(F.length(run) >= n, F.transform(
            F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, n))).otherwise(none)))

    found = computed_once(joined, {"_found": F.array_intersect(F.flatten(F.transform(runs, cuts)), F.col("_list.words"))})
    counts = [F.coalesce(F.size(F.array_intersect(F.col(f"_list.c{i}"), F.col("_found"))), F.lit(0)) for i in range(classes)]
    known = F.col("_found").isNotNull()
    return computed_once(found, {name: F.array(*[F.when(known, n).otherwise(0) for n in counts])}).drop("_list", "_found")


def count_hits(df: DataFrame, column: str, vocab: DataFrame, key: str | Sequence[str] | None = None,
               by: str | Sequence[str] | None = None) -> DataFrame:
    """Add `core_hits` and `support_hits`: how many words of each kind occur in the text."""
    classed = vocab.select(*names(by), "token", F.when(F.col("kind") == "core", 0).otherwise(1).alias("class"))
    found = word_hits(df, column, classed, 2, by, "_hits")
    return found.withColumns({"core_hits": F.col("_hits")[0], "support_hits": F.col("_hits")[1]}).drop("_hits")


def score_relevance(df: DataFrame, column: str, vocab: DataFrame, key: str | Sequence[str],
                    by: str | Sequence[str] | None = None, core_pt: float = fv.CORE_POINTS,
                    sup_pt: float = fv.SUPPORT_POINTS, cut: float = fv.SCORE_CUT) -> DataFrame:
    """Points for each vocabulary word in the text; `stock` needs the cut and at least one core word."""
    hit = count_hits(df, column, vocab, key, by)
    score = F.col("core_hits") * F.lit(core_pt) + F.col("support_hits") * F.lit(sup_pt)
    passed = (F.col("stock_score") >= cut) & (F.col("core_hits") > 0)
    return hit.withColumn("stock_score", score).withColumn("is_stock", F.when(passed, "stock").otherwise("other"))


def assign_topic(df: DataFrame, column: str, topics: Mapping[str, str] | None = None, default: str = fv.OTHER_TOPIC,
                 name: str = "topic") -> DataFrame:
    """First topic in priority order whose pattern occurs, whatever the case."""
    topics = fv.NEWS_TOPICS if topics is None else topics
    choice = None
    for label, pattern in topics.items():
        hit = flag(F.rlike(F.col(column), F.lit(f"(?iu){pattern}")))
        choice = F.when(hit, F.lit(label)) if choice is None else choice.when(hit, F.lit(label))
    return df.withColumn(name, choice.otherwise(F.lit(default)))


Scorer = Callable[[pd.Series], pd.DataFrame]


def score_text(df: DataFrame, column: str, load: Callable[[], Scorer], outputs: Sequence[str],
               batch: int = 64) -> DataFrame:
    """Add model scores to the rows that have text.

    `load` is called once per task and returns a function from a batch of texts to a table of scores
    with the named columns. Blank rows are filtered before, as no filter passes through the function.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    schema = fields + "".join(f", `{o}` double" for o in outputs)

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for table in tables:
            scores = [scorer(table[column].iloc[i:i + batch]) for i in range(0, len(table), batch)]
            if not scores:
                continue
            merged = pd.concat(scores, ignore_index=True)
            yield pd.concat([table.reset_index(drop=True), merged[list(outputs)]], axis=1)

    return tx_filter(df, column).mapInPandas(run, schema)


def lexicon_scorer(positive: Sequence[str], negative: Sequence[str]) -> Callable[[], Scorer]:
    """Loader of a small stand-in for a sentiment model: smoothed word counts as three probabilities."""
    def load() -> Scorer:
        import re

        plus, minus = re.compile(tx.any_of(positive, True)), re.compile(tx.any_of(negative, True))

        def score(texts: pd.Series) -> pd.DataFrame:
            pos, neg = texts.str.count(plus), texts.str.count(minus)
            total = pos + neg + 1.0
            return pd.DataFrame({"p_pos": pos / total, "p_neu": 1.0 / total, "p_neg": neg / total}).reset_index(drop=True)

        return score

    return load


def sentiment_norm(pos: Column, neg: Column) -> Column:
    return (pos - neg) / (pos + neg + fv.EPS)


def sentiment_columns(df: DataFrame, pos: str = "p_pos", neu: str = "p_neu", neg: str = "p_neg",
                      clip_norm: bool = True) -> DataFrame:
    """Raw and normalised sentiment and the most probable label; ties go to neg, then neu."""
    p, u, n = F.col(pos), F.col(neu), F.col(neg)
    norm = sentiment_norm(p, n)
    return df.withColumns({
        "sentiment_raw": p - n,
        "sentiment_norm": clip(norm, -1.0, 1.0) if clip_norm else norm,
        "sentiment_label": F.when((n >= u) & (n >= p), "neg").when(u >= p, "neu").otherwise("pos"),
    })


def token_length_profile(df: DataFrame, column: str, seeds: Sequence[str] = tuple(fv.MARKET_SEEDS),
                         pattern: str = fv.HANGUL_RUN, max_length: int = 10) -> DataFrame:
    """Tokens per length, from 1 to the largest, and the share of them that are seed words (0 where there are none)."""
    runs = df.select(F.explode(tx.tokens(column, pattern)).alias("token"))
    counted = runs.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    seeded = F.when(F.rlike("token", F.lit(tx.any_of(seeds))), F.col("n")).otherwise(0)
    found = counted.where(F.length("token") <= max_length).groupBy(F.length("token").alias("token_length")).agg(
        F.sum("n").alias("tokens"), (F.sum(seeded) / F.sum("n")).alias("seed_share"))
    lengths = df.sparkSession.range(1, max_length + 1).select(F.col("id").cast("int").alias("token_length"))
    return lengths.join(found, "token_length", "left").fillna({"tokens": 0, "seed_share": 0.0})


def seed_tokens(df: DataFrame, column: str, min_length: int, max_length: int | None = None, k: int = 8,
                seeds: Sequence[str] = tuple(fv.MARKET_SEEDS), pattern: str = fv.HANGUL_RUN) -> DataFrame:
    """The k most frequent seed words of the given lengths."""
    runs = df.select(F.explode(tx.tokens(column, pattern)).alias("token"))
    fits = F.length("token") >= min_length
    if max_length is not None:
        fits = fits & (F.length("token") <= max_length)
    counted = runs.where(fits).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.rlike("token", F.lit(tx.any_of(seeds)))).orderBy(F.desc("n"), "token").limit(k)


def decode_list_text(df: DataFrame, column: str, name: str = "item") -> DataFrame:
    """One row per item of a list that was written as text."""
    return df.withColumn(name, F.explode(tx.list_items(column)))
