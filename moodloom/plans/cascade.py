"""From raw comments to daily sentiment, as one lazy plan per group of years."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators.aggregates import daily_sentiment, stage_summary
from ..operators.classify import (
    flag_patterns,
    keyword_df,
    Scorer,
    lexicon_toxicity,
    match_keywords,
    score_relevance,
    score_text,
    sentiment_columns,
    toxicity_weight,
)
from ..operators.filters import drop_empty_text, score_filter
from ..operators.joining import bounded_join
from ..session import settle


def political_stage(comments: DataFrame, text: str = "text_raw", patterns: Sequence[str] = tuple(fv.POLITICAL_PATTERNS)) -> DataFrame:
    """Comments with text, flagged, with the political words found."""
    return match_keywords(flag_patterns(drop_empty_text(comments, text), text, patterns), text, patterns)


def toxicity_stage(comments: DataFrame, text: str = "text_raw", gamma: float = fv.GAMMA, hard_tau: float = fv.HARD_TAU,
                   **lexicon) -> DataFrame:
    return toxicity_weight(lexicon_toxicity(comments, text, **lexicon), text, gamma=gamma, hard_tau=hard_tau)


def topical_stage(comments: DataFrame, text: str = "text_raw", key: str = "comment_id", by: str = "year",
                  seeds: Sequence[str] = tuple(fv.MARKET_SEEDS), min_ratio: float = fv.MIN_DOC_RATIO) -> DataFrame:
    """Vocabulary of each group from its own comments, then a relevance score per comment."""
    filled = drop_empty_text(comments, text)
    words = keyword_df(filled, text, None, seeds, by, min_ratio)
    return score_relevance(filled, text, words, key, by)


def sentiment_stage(scored: DataFrame, ts: str = "comment_at", weight: str | None = "weight",
                    tz: str | None = fv.LOCAL_ZONE) -> DataFrame:
    """Daily sentiment from comment probabilities."""
    labelled = sentiment_columns(scored)
    return daily_sentiment(labelled, ts, "p_pos", "p_neu", "p_neg", weight, tz, "comment_id")


def filter_summary(comments: DataFrame, by: str, text: str = "text_raw", patterns=tuple(fv.POLITICAL_PATTERNS),
                   **lexicon) -> DataFrame:
    """Flags, toxicity and keep counts per group in a single pass: no join, one small shuffle."""
    staged = toxicity_stage(flag_patterns(comments, text, patterns), text, **lexicon)
    return stage_summary(
        staged, {"political": F.col("is_political"), "empty_rows": F.col("is_empty"), "kept": F.col("keep")}, by,
        means={"mean_toxicity": F.when(~F.col("is_empty"), F.col("toxicity_score")), "mean_weight": F.col("weight")})


def comment_cascade(comments: DataFrame, load: Callable[[], Scorer], text: str = "text_raw", key: str = "comment_id",
                    ts: str = "comment_at", by: str = "year", patterns: Sequence[str] = tuple(fv.POLITICAL_PATTERNS),
                    seeds: Sequence[str] = tuple(fv.MARKET_SEEDS), min_ratio: float = fv.MIN_DOC_RATIO,
                    cut: float = fv.SCORE_CUT, tz: str | None = fv.LOCAL_ZONE, **lexicon) -> DataFrame:
    """Comments to daily sentiment: each stage works on the rows the one before kept.

    The toxic stage's result is written once, as both the vocabulary and the scores read it.
    """
    calm = political_stage(comments, text, patterns).where(~F.col("is_political")).select(key, by, ts, text)
    clean = settle(toxicity_stage(calm, text, **lexicon).where("keep").select(key, by, ts, text, "weight"))
    topical = score_filter(topical_stage(clean, text, key, by, seeds, min_ratio), "stock_score", cut, "core_hits")
    scored = score_text(topical.select(key, ts, text, "weight"), text, load, ["p_pos", "p_neu", "p_neg"])
    return daily_sentiment(sentiment_columns(scored), ts, "p_pos", "p_neu", "p_neg", "weight", tz, key)


def stage_report(comments: DataFrame, by: str = "year", text: str = "text_raw",
                 patterns: Sequence[str] = tuple(fv.POLITICAL_PATTERNS), **lexicon) -> DataFrame:
    """Counts per group with nested lists: documents per political word and per toxicity reason, most frequent first.

    Words and reasons come from fixed lists, so the nested lists are short whatever the corpus.
    """
    staged = settle(toxicity_stage(political_stage(comments, text, patterns), text, **lexicon).select(
        by, "is_political", "matched_keywords", "toxicity_reason", "keep"))
    counts = staged.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if("is_political").alias("political"),
                                    F.count_if(~F.col("keep")).alias("toxic"))
    reasons = F.filter(F.split("toxicity_reason", r"\|"), lambda r: r != "")
    for name, values in (("words", F.col("matched_keywords")), ("reasons", reasons)):
        each = staged.select(by, F.explode(values).alias("name")).groupBy(by, "name").agg(F.count(F.lit(1)).alias("n"))
        listed = each.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("down"), "name"))).alias(name))
        listed = listed.withColumn(name, F.transform(name, lambda s: F.struct(s["name"].alias("name"), (-s["down"]).alias("n"))))
        counts = bounded_join(counts, listed, [by], "left")
    return counts
