"""Parameter sweeps.

Whatever does not depend on the parameter (token counts, word hits, probabilities) is computed once.
Where a grid point only changes an expression, all points are aggregated side by side in one pass and
turned into rows afterwards; where it changes a window, the points travel through it as an array.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..functions.columns import grid, local_date, names
from ..session import settle
from .aggregates import with_grid
from .classify import DOCUMENT, sentiment_norm, token_counts, weight_of, word_hits
from .joining import bounded_join
from .risk import perf_metrics, position_size, recent_return
from .series import ordered


def as_rows(df: DataFrame, keys: Sequence[str], cells: Sequence[Mapping[str, Column]]) -> DataFrame:
    """One row per cell of a wide aggregate."""
    packed = F.array(*[F.struct(*[value.alias(name) for name, value in cell.items()]) for cell in cells])
    return df.select(*keys, F.explode(packed).alias("_c")).select(*keys, "_c.*")


def _dated(df: DataFrame, ts: str, tz: str | None, score: str, pos: str, neg: str) -> DataFrame:
    """Rows with a score; others are no part of a sweep."""
    return df.where(F.col(score).cast("double").isNotNull()).select(local_date(ts, tz).alias("date"), F.col(score).cast("double").alias("_tox"),
                     sentiment_norm(F.col(pos), F.col(neg)).alias("_norm"))


def _daily_by_weight(rows: DataFrame, weights: Sequence[Column]) -> DataFrame:
    """Daily weighted sentiment of several weightings side by side."""
    known = F.col("_norm").isNotNull()
    sums = []
    for i, w in enumerate(weights):
        sums.append(F.sum(F.when(known, w * F.col("_norm"))).alias(f"_v{i}"))
        sums.append(F.sum(F.when(known, w)).alias(f"_w{i}"))
    daily = rows.where(known & F.col("date").isNotNull()).groupBy("date").agg(*sums)
    return daily.select("date", *[(F.col(f"_v{i}") / (F.col(f"_w{i}") + fv.EPS)).alias(f"d{i}")
                                  for i in range(len(weights))])


def _gaps(daily: DataFrame, base: str, count: int) -> DataFrame:
    """Mean and largest distance, and correlation, of each daily series to the base one."""
    parts = []
    for i in range(count):
        gap = F.abs(F.col(f"d{i}") - F.col(base))
        parts += [F.avg(gap).alias(f"mad{i}"), F.max(gap).alias(f"max{i}"), F.corr(f"d{i}", base).alias(f"corr{i}")]
    return daily.agg(*parts)


def gamma_series(df: DataFrame, ts: str, score: str, pos: str, neg: str, gammas: Sequence[float],
                 tz: str | None = fv.LOCAL_ZONE) -> DataFrame:
    """Daily weighted sentiment for several gammas, one column each (g0, g1, ...)."""
    rows = _dated(df, ts, tz, score, pos, neg)
    daily = _daily_by_weight(rows, [weight_of(F.col("_tox"), g) for g in gammas])
    return daily.withColumnsRenamed({f"d{i}": f"g{i}" for i in range(len(gammas))})


def sweep_gamma(df: DataFrame, gammas: Sequence[float] = tuple(fv.GAMMA_GRID), *, ts: str = "comment_at",
                score: str = "toxicity_score", pos: str = "p_pos", neg: str = "p_neg",
                tz: str | None = fv.LOCAL_ZONE) -> DataFrame:
    """Effect of the weight exponent: effective share of the rows and distance to the unweighted series."""
    rows = _dated(df, ts, tz, score, pos, neg)
    weights = [weight_of(F.col("_tox"), g) for g in gammas]
    daily = _daily_by_weight(rows, [*weights, F.lit(1.0)])
    compared = _gaps(daily, f"d{len(gammas)}", len(gammas))
    sizes = rows.agg(F.count(F.lit(1)).alias("_n"), *[
        e for i, w in enumerate(weights) for e in (F.sum(w).alias(f"_s{i}"), F.sum(w * w).alias(f"_q{i}"))])
    compared_rows = as_rows(compared, [], [
        {"gamma": F.lit(float(g)), "mad": F.col(f"mad{i}"), "maxabs": F.col(f"max{i}"), "corr": F.col(f"corr{i}")}
        for i, g in enumerate(gammas)])
    size_rows = as_rows(sizes, [], [
        {"gamma": F.lit(float(g)), "w30": F.lit(0.7**g), "w50": F.lit(0.5**g), "w80": F.lit((1 - 0.8) ** g),
         "eff_ratio": F.col(f"_s{i}") * F.col(f"_s{i}") / (F.col(f"_q{i}") + fv.EPS) / F.col("_n")}
        for i, g in enumerate(gammas)])
    return size_rows.join(compared_rows, "gamma")


def sweep_tau(df: DataFrame, taus: Sequence[float] = tuple(fv.TAU_GRID), *, base_tau: float = fv.HARD_TAU,
              gamma: float = fv.GAMMA, ts: str = "comment_at", score: str = "toxicity_score", pos: str = "p_pos",
              neg: str = "p_neg", tz: str | None = fv.LOCAL_ZONE) -> DataFrame:
    """Rows each cut drops; for cuts up to the base one also the change of the daily series."""
    rows = _dated(df, ts, tz, score, pos, neg)
    w = weight_of(F.col("_tox"), gamma)
    strict = [t for t in taus if t <= base_tau]
    daily = _daily_by_weight(rows, [*[F.when(F.col("_tox") >= t, 0.0).otherwise(w) for t in strict], w])
    compared = as_rows(_gaps(daily, f"d{len(strict)}", len(strict)), [], [
        {"tau": F.lit(float(t)), "mad": F.col(f"mad{i}"), "maxabs": F.col(f"max{i}")} for i, t in enumerate(strict)])
    counts = rows.agg(F.count(F.lit(1)).alias("_n"),
                      *[F.count_if(F.col("_tox") >= t).alias(f"_d{i}") for i, t in enumerate(taus)])
    dropped = as_rows(counts, [], [
        {"tau": F.lit(float(t)), "dropped": F.col(f"_d{i}"), "dropped_pct": 100.0 * F.col(f"_d{i}") / F.col("_n"),
         "remaining": F.col("_n") - F.col(f"_d{i}")} for i, t in enumerate(taus)])
    return dropped.join(compared, "tau", "left")


def sweep_window(df: DataFrame, column: str, windows: Sequence[tuple[int, int]] = tuple(fv.WINDOW_GRID),
                 seeds: Sequence[str] = tuple(fv.MARKET_SEEDS), min_ratio: float = fv.MIN_DOC_RATIO,
                 pattern: Callable[[int, int], str] = fv.token_pattern) -> DataFrame:
    """Number of core words per token window. All windows are read in one pass over the text."""
    lists = F.array(*[
        F.struct(F.lit(f"{lo}-{hi}").alias("window"),
                 F.array_append(F.array_distinct(tx.tokens(column, pattern(lo, hi))), F.lit(DOCUMENT)).alias("words"))
        for lo, hi in windows])
    rows = df.where(tx.has_text(column)).select(F.explode(lists).alias("_l")).select(
        "_l.window", F.explode("_l.words").alias("token"))
    counts = settle(rows.groupBy("window", "token").agg(F.count(F.lit(1)).alias("doc_count")))
    totals = counts.where(F.col("token") == DOCUMENT).select("window", F.col("doc_count").alias("documents"))
    words = counts.where(F.col("token") != DOCUMENT)
    joined = bounded_join(words, totals, ["window"], "inner", settled=True)
    core = F.rlike("token", F.lit(tx.any_of(seeds))) & (F.col("doc_count") >= F.col("documents") * F.lit(min_ratio))
    found = joined.groupBy("window").agg(F.count_if(core).alias("core"))
    every = df.sparkSession.createDataFrame([(f"{lo}-{hi}",) for lo, hi in windows], "window string")
    return every.join(found, "window", "left").fillna({"core": 0})


def hit_table(df: DataFrame, column: str, key: str, by: str | Sequence[str], ratios: Sequence[float],
              bands: Sequence[float], seeds: Sequence[str], token_regex: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What every vocabulary sweep needs, computed once.

    The first table holds the words any grid point could use, with their document counts; the second one, per
    document, how many words it has from each step: a word's step is how many of the grid's shares it reaches.
    """
    keys, shares = names(by), _shares(ratios, bands)
    counts = token_counts(df, column, keys, token_regex)
    totals = counts.where(F.col("token") == DOCUMENT).select(*keys, F.col("doc_count").alias("documents"))
    words = counts.where((F.col("token") != DOCUMENT) & F.rlike("token", F.lit(tx.any_of(seeds))))
    step = sum([(F.col("doc_count") >= F.col("documents") * F.lit(r) * F.lit(b)).cast("int") for r, b in shares], F.lit(0))
    words = settle(bounded_join(words, totals, keys, "inner", settled=True).withColumn("class", step - 1).where("class >= 0"))
    texts = df.where(tx.has_text(column)).select(*keys, key, column)
    hits = word_hits(texts, column, words.select(*keys, "token", "class"), len(shares), keys)
    return words, settle(hits.select(*keys, key, "hits"))


def _shares(ratios: Sequence[float], bands: Sequence[float]) -> list[tuple[float, float]]:
    """Every share of documents (ratio times band) at which some grid point changes its mind, ascending."""
    return sorted({(r, b) for r in ratios for b in (1.0, *bands)}, key=lambda p: (p[0] * p[1], p))


def _kinds(ratio: float, band: float) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    def core(h: Column) -> Column:
        return h["doc_count"] >= h["documents"] * F.lit(ratio)

    def support(h: Column) -> Column:
        return ~core(h) & (h["doc_count"] >= h["documents"] * F.lit(ratio) * F.lit(band))

    return core, support


def _pass_share(shares: Sequence[tuple[float, float]], ratio: float, band: float, core_pt: float, sup_pt: float, cut: float) -> Column:
    """Share of documents that reach the cut; words from `ratio` on are core words, those below from ratio * band on
    support words."""
    core, support = shares.index((ratio, 1.0)), shares.index((ratio, band))
    n_core = sum([F.col("hits")[i] for i in range(core, len(shares))], F.lit(0))
    n_support = sum([F.col("hits")[i] for i in range(support, core)], F.lit(0))
    keep = (n_core * F.lit(core_pt) + n_support * F.lit(sup_pt) >= cut) & (n_core > 0)
    return keep.cast("int")


def _passed(hits: DataFrame, keep: Sequence[Column]) -> DataFrame:
    """Documents, and passing ones per grid point."""
    return hits.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(k).alias(f"n{i}") for i, k in enumerate(keep)])


def _share_cells(i: int) -> dict[str, Column]:
    return {"pass_pct": 100.0 * F.col(f"n{i}") / F.col("_n"), "n_pass": F.col(f"n{i}")}


def _word_means(words: DataFrame, keys: Sequence[str], groups: DataFrame, points: Sequence[tuple[float, float]]) -> DataFrame:
    """Mean number of core and support words per group for each (ratio, band)."""
    fields = F.struct("doc_count", "documents")
    parts = []
    for i, (ratio, band) in enumerate(points):
        core, support = _kinds(ratio, band)
        parts += [F.count_if(core(fields)).alias(f"c{i}"), F.count_if(support(fields)).alias(f"s{i}")]
    per_group = groups.join(words.groupBy(*keys).agg(*parts), list(keys), "left")
    return per_group.agg(*[F.avg(F.coalesce(F.col(f"{k}{i}"), F.lit(0))).alias(f"{k}{i}")
                           for i in range(len(points)) for k in ("c", "s")])


def sweep_df(df: DataFrame, column: str, key: str, by: str | Sequence[str],
             ratios: Sequence[float] = tuple(fv.RATIO_GRID), *, band: float = fv.SUPPORT_BAND,
             seeds: Sequence[str] = tuple(fv.MARKET_SEEDS), core_pt: float = fv.CORE_POINTS,
             sup_pt: float = fv.SUPPORT_POINTS, cut: float = fv.SCORE_CUT, token_regex: str | None = None) -> DataFrame:
    """Vocabulary size and share of passing documents per document-frequency ratio."""
    words, hits = hit_table(df, column, key, by, ratios, [band], seeds, token_regex)
    groups = hits.select(*names(by)).distinct()
    sizes = _word_means(words, names(by), groups, [(r, band) for r in ratios])
    size_rows = as_rows(sizes, [], [{"ratio": F.lit(float(r)), "core": F.col(f"c{i}"), "support": F.col(f"s{i}")}
                                    for i, r in enumerate(ratios)])
    steps = _shares(ratios, [band])
    shares = _passed(hits, [_pass_share(steps, r, band, core_pt, sup_pt, cut) for r in ratios])
    return size_rows.join(as_rows(shares, [], [
        {"ratio": F.lit(float(r)), **_share_cells(i)} for i, r in enumerate(ratios)]), "ratio")


def sweep_df_words(df: DataFrame, column: str, by: str | Sequence[str], ratios: Sequence[float] = tuple(fv.RATIO_GRID),
                   n: int = 30, *, seeds: Sequence[str] = tuple(fv.MARKET_SEEDS),
                   token_regex: str | None = None) -> DataFrame:
    """The n most frequent core words over all groups for each ratio."""
    keys = names(by)
    counts = token_counts(df, column, keys, token_regex)
    totals = counts.where(F.col("token") == DOCUMENT).select(*keys, F.col("doc_count").alias("documents"))
    words = counts.where((F.col("token") != DOCUMENT) & F.rlike("token", F.lit(tx.any_of(seeds))))
    joined = bounded_join(words, totals, keys, "inner", settled=True)
    gridded = with_grid(joined, [{"ratio": float(r)} for r in ratios]).where(
        F.col("doc_count") >= F.col("documents") * F.col("ratio"))
    summed = gridded.groupBy("ratio", "token").agg(F.sum("doc_count").alias("n"))
    best = Window.partitionBy("ratio").orderBy(F.desc("n"), "token")
    return summed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def sweep_points(df: DataFrame, column: str, key: str, by: str | Sequence[str],
                 points: Sequence[tuple[float, float]] = tuple(fv.POINT_GRID), *, ratio: float = fv.MIN_DOC_RATIO,
                 band: float = fv.SUPPORT_BAND, seeds: Sequence[str] = tuple(fv.MARKET_SEEDS),
                 cut: float = fv.SCORE_CUT, token_regex: str | None = None) -> DataFrame:
    """Share of passing documents per pair of core and support points."""
    _, hits = hit_table(df, column, key, by, [ratio], [band], seeds, token_regex)
    steps = _shares([ratio], [band])
    shares = _passed(hits, [_pass_share(steps, ratio, band, c, s, cut) for c, s in points])
    return as_rows(shares, [], [
        {"label": F.lit(f"{c}:{s}"), "core_pt": F.lit(c), "sup_pt": F.lit(s), **_share_cells(i)}
        for i, (c, s) in enumerate(points)])


def sweep_band(df: DataFrame, column: str, key: str, by: str | Sequence[str],
               bands: Sequence[float] = tuple(fv.BAND_GRID), *, ratio: float = fv.MIN_DOC_RATIO,
               seeds: Sequence[str] = tuple(fv.MARKET_SEEDS), core_pt: float = fv.CORE_POINTS,
               sup_pt: float = fv.SUPPORT_POINTS, cut: float = fv.SCORE_CUT, token_regex: str | None = None) -> DataFrame:
    """Number of support words and share of passing documents per support band."""
    words, hits = hit_table(df, column, key, by, [ratio], bands, seeds, token_regex)
    groups = hits.select(*names(by)).distinct()
    sizes = _word_means(words, names(by), groups, [(ratio, b) for b in bands])
    size_rows = as_rows(sizes, [], [
        {"band": F.lit(float(b)), "band_lo_pct": F.lit(ratio * b * 100), "support": F.col(f"s{i}")}
        for i, b in enumerate(bands)])
    steps = _shares([ratio], bands)
    shares = _passed(hits, [_pass_share(steps, ratio, b, core_pt, sup_pt, cut) for b in bands])
    return size_rows.join(as_rows(shares, [], [
        {"band": F.lit(float(b)), **_share_cells(i)} for i, b in enumerate(bands)]), "band")


def sweep_cut(df: DataFrame, cuts: Sequence[float] = tuple(fv.CUT_GRID), *, score: str = "stock_score",
              core: str | Column = "core_hits") -> DataFrame:
    """Share of documents per score cut, with and without the core-word rule. One pass for all cuts."""
    hit = (F.col(core) > 0) if isinstance(core, str) else core
    parts = []
    for i, cut in enumerate(cuts):
        reach = F.col(score) >= cut
        parts += [(100.0 * F.avg((reach & hit).cast("double"))).alias(f"w{i}"),
                  (100.0 * F.avg(reach.cast("double"))).alias(f"o{i}"), F.count_if(reach & ~hit).alias(f"a{i}")]
    return as_rows(df.agg(*parts), [], [
        {"cut": F.lit(float(c)), "pass_pct": F.col(f"w{i}"), "pass_without_core": F.col(f"o{i}"),
         "aux_only": F.col(f"a{i}")} for i, c in enumerate(cuts)])


def exposure_grid(ranges: Sequence[tuple[float, float]] = tuple(fv.MULTIPLIER_GRID),
                  regimes: Sequence[tuple[float, float, float]] = tuple(fv.REGIME_GRID)) -> list[dict[str, float]]:
    return [{"k_min": lo, "k_max": hi, "bull": b, "normal": m, "crisis": c}
            for lo, hi in ranges for b, m, c in regimes]


def sweep_exposure(df: DataFrame, points: Sequence[Mapping[str, float]] | None = None, momentum: bool = True,
                   score: str = "index_score", ret: str = "target_reg", order: str = "date", by=None) -> DataFrame:
    """Performance per multiplier range and regime weights; the adopted point is marked.

    The sizes of all grid points are one array column of a row, so the shuffle does not grow with the grid.
    """
    points = exposure_grid() if points is None else points
    by = names(by)
    keys = [*by, "k_min", "k_max", "bull", "normal", "crisis"]
    d = recent_return(df.select(*by, order, score, ret, "trend_strength", "egarch_vol", "vol_shock", "regime"), ret, order, by)
    sizes = F.transform(grid(points), lambda p: position_size(
        momentum, score, (p["k_min"], p["k_max"]), {c: p[c] for c in ("bull", "normal", "crisis")}))
    d = d.withColumn("_size", sizes).select(*by, order, ret, "_size")
    # One window for all points: rows are copied only after it, and its partitioning serves the figures too.
    flat = F.array_repeat(F.lit(0.0), len(points))
    w = ordered(order, by)
    held = d.withColumns({f"_held{n}": F.coalesce(F.lag("_size", n).over(w), flat) for n in (1, 2)})
    cells = F.arrays_zip(grid(points).alias("p"), F.col("_held1").alias("now"), F.col("_held2").alias("before"))
    rows = held.select(*by, order, ret, F.explode(cells).alias("_c"))
    now, before = [F.coalesce(F.col(f"_c.{c}"), F.lit(0.0)) for c in ("now", "before")]
    rows = rows.select(*by, order, ret, "_c.p.*", (now * F.col(ret) - F.abs(now - before) * F.lit(fv.FEE)).alias("strat_ret"))
    figures = perf_metrics(rows, "strat_ret", ret, order, keys)
    low, high = fv.MULTIPLIER_RANGE
    adopted = ((F.col("k_min") == low) & (F.col("k_max") == high)
               & (F.col("bull") == fv.REGIME_MULTIPLIER["bull"]) & (F.col("crisis") == fv.REGIME_MULTIPLIER["crisis"]))
    return figures.withColumn("adopted", adopted)
