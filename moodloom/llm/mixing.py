"""Mixing sources to target weights as a minimum-cost flow, for sources that may overlap.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow routes each pattern's words to
the quotas of its sources; the r-th repetition of a pattern costs r - 1, so costs are convex and fresh words go first.
Documents are then selected in a seeded order, pattern by pattern, until the routed words are reached.

Only patterns and sources reach the driver, never documents; more than `MOST_PATTERNS` of them raise an error. The
selection needs no total order: hash buckets are summed first, and only the bucket in which the limit falls is ordered.
A document is taken whole, so a first run stops below the limit; further runs fill the gap with documents that fit.

Null sources form a source of their own, which comes last. Null and empty texts have size 0 and are never taken. Repeated
rows are documents of their own. An empty table gives an empty result. Any further columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

WEIGHTS, REPEATS, SEED, FILLS = (1, 2, 3), 3, "mix", 3
MOST_PATTERNS = 100_000
#: Documents that a bucket of the selection holds on average, at most.
BUCKET = 4096


def quotas(sizes: Sequence[int], weights: Sequence[float], repeats: int = REPEATS) -> list[float]:
    """Share all words by weight; what exceeds `repeats` times a source's words is shared again among the others."""
    total, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > repeats * sizes[i]}
        for i in full or open_:
            out[i] = float(repeats * sizes[i]) if full else unit * weights[i]
        open_ = open_ - full if full else set()
    return out


def route(capacity: Sequence[int], members: Sequence[Sequence[int]], quota: Sequence[int], repeats: int = REPEATS) -> dict[tuple[int, int], int]:
    """Words from pattern to source, at least total cost: successive cheapest paths.

    The cost of a path is that of the repetition it uses, so all paths of one repetition are exhausted before the next.
    """
    left, spare, flow = list(quota), [0] * len(capacity), {}
    users: list[set[int]] = [set() for _ in quota]
    for _ in range(repeats):
        spare = [a + b for a, b in zip(spare, capacity, strict=True)]
        while True:
            came: dict[int, tuple[int, int]] = {}
            start = deque(p for p, n in enumerate(spare) if n > 0)
            known, end = set(start), None
            while start and end is None:
                p = start.popleft()
                for s in members[p]:
                    if s not in came:
                        came[s] = (p, s)
                        if left[s] > 0:
                            end = s
                            break
                        for other in users[s]:
                            if other not in known:
                                known.add(other)
                                came[-1 - other] = (s, other)
                                start.append(other)
            if end is None:
                break
            path, s = [], end
            while True:
                p = came[s][0]
                path.append((p, s))
                if -1 - p not in came:
                    break
                s = came[-1 - p][0]
            back = [(b[0], a[1]) for a, b in zip(path[1:], path[:-1], strict=True)]
            step = min([spare[path[-1][0]], left[end], *(flow[e] for e in back)])
            for e in path:
                flow[e] = flow.get(e, 0) + step
                users[e[1]].add(e[0])
            for e in back:
                flow[e] -= step
                if not flow[e]:
                    users[e[1]].discard(e[0])
            spare[path[-1][0]] -= step
            left[end] -= step
    return {e: n for e, n in flow.items() if n}


def _first_fit(rows: DataFrame, limits: DataFrame, digits: int, last: bool) -> DataFrame:
    """Rows (pattern, pick, doc_id, size) that come first in the order of `pick`, up to each pattern's limit.

    The last run goes to whichever end of a document is nearer to the limit; the others stay below it.
    """
    fits = F.expr("2 * before + size <= 2 * need" if last else "before + size <= need")
    bucket = F.substring("pick", 1, digits)
    rows = rows.join(F.broadcast(limits), "pattern").where("size > 0").where(F.col("size") <= F.col("need") * (2 if last else 1)).withColumn("bucket", bucket)
    ahead = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    rows = rows.join(sums, ["pattern", "bucket"])
    inside = rows.where("base < need and base + words > need")
    order = Window.partitionBy("pattern", "bucket").orderBy("pick", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(order), F.lit(0))).where(fits)
    keep = ["pattern", "pick", "doc_id", "size", "row"]
    return rows.where("base + words <= need").select(keep).unionByName(inside.select(keep))


def mix(sized: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED, fills: int = FILLS) -> DataFrame:
    """Rows (doc_id, size, sources: array) with how often each is taken.

    Sources in code-point order, null last, get the weights in turn. Returns doc_id, size, sources, row, times,
    and `figures`: source, source_size, target and routed words of each of its sources.
    """
    spark = sized.sparkSession
    named = F.transform("sources", lambda s: F.struct(s.isNull().alias("last"), s.alias("name")))
    sized = sized.withColumn("members", F.array_sort(F.array_distinct(named)))
    patterns = sized.groupBy("members").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    patterns.sort(key=lambda r: [(m["last"], (m["name"] or "").encode()) for m in r["members"]])
    names = sorted({(m["last"], (m["name"] or "").encode(), m["name"]) for r in patterns for m in r["members"]}, key=lambda x: x[:2])
    place = {n[::2]: i for i, n in enumerate(names)}
    members = [[place[m["last"], m["name"]] for m in r["members"]] for r in patterns]
    sizes = [sum(r["words"] for r, own in zip(patterns, members, strict=True) if i in own) for i in range(len(names))]
    # Overlaps make the sum of the sources larger than what there is; quotas share the words that exist.
    shares = quotas(sizes, [weights[i % len(weights)] for i in range(len(names))], repeats)
    scale = sum(r["words"] for r in patterns) / max(1, sum(sizes))
    shares = [x * scale if scale < 1 else x for x in shares]
    flow = route([r["words"] for r in patterns], members, [round(x) for x in shares], repeats)
    rows, figures = [], []
    for p, r in enumerate(patterns):
        routed = sum(n for (a, _), n in flow.items() if a == p)
        whole, need = divmod(routed, r["words"]) if r["words"] else (0, 0)
        rows.append((p, whole, need))
        figures.append((r["members"], p, whole, [(names[s][2], sizes[s], shares[s], flow.get((p, s), 0)) for s in members[p]]))
    kinds = spark.createDataFrame(figures, (
        "members array<struct<last: boolean, name: string>>, pattern long, whole long, "
        "figures array<struct<source: string, source_size: long, target: double, routed: long>>"))
    limits = spark.createDataFrame(rows, "pattern long, whole long, need long").select("pattern", "need")
    most, digits = max([r["n"] for r in patterns], default=0), 1
    while most > BUCKET * 16 ** digits:
        digits += 1
    pick = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("row").cast("string")).cast("binary"))
    # Identical rows are told apart by a number within their id, which only ids that repeat need.
    same = Window.partitionBy("doc_id").orderBy("size", "members")
    sized = sized.withColumn("row", F.row_number().over(same).cast("long"))
    # At most MOST_PATTERNS rows, so the broadcast is bounded.
    base = c.settle(sized.join(F.broadcast(kinds), "members").withColumn("pick", pick), "picks")
    chosen, open_ = None, base.select("pattern", "pick", "doc_id", "size", "row")
    for fill in range(max(1, fills)):
        last = fill == max(1, fills) - 1
        got = c.settle(_first_fit(open_, limits, digits, last), "chosen")
        chosen = got if chosen is None else chosen.unionByName(got)
        if last:
            break
        limits = c.settle(limits.join(got.groupBy("pattern").agg(F.sum("size").alias("got")), "pattern", "left").select(
            "pattern", (F.col("need") - F.coalesce("got", F.lit(0))).alias("need")), "limits")
        # Null ids are ids here: a chosen document leaves, whatever its id.
        open_ = open_.alias("o").join(got.alias("g"), (F.col("o.pick") == F.col("g.pick")) & F.col("o.doc_id").eqNullSafe(F.col("g.doc_id")) & (
            F.col("o.row") == F.col("g.row")), "left_anti")
    taken = chosen.select("doc_id", "row", F.lit(1).alias("more"))
    same_doc = (F.col("b.doc_id").eqNullSafe(F.col("t.doc_id"))) & (F.col("b.row") == F.col("t.row"))
    return base.alias("b").join(taken.alias("t"), same_doc, "left").select(
        "b.doc_id", "b.size", "b.sources", "b.row", (F.col("b.whole") + F.coalesce("t.more", F.lit(0))).alias("times"), "b.figures")


def sized_documents(docs: DataFrame) -> DataFrame:
    """Words of each text, and its one source."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(c.WORD)).cast("long")
    return c.as_documents(docs, ("doc_id", "text", "source")).select("doc_id", words.alias("size"), F.array("source").alias("sources"))


def mixed_words(docs: DataFrame) -> DataFrame:
    """Documents with their source's figures and the words that the mix takes from them, repeats counted."""
    one = F.col("figures")[0]
    return mix(sized_documents(docs)).select(
        "doc_id", "size", one["source_size"].alias("source_size"), one["target"].alias("target"),
        (F.col("size") * F.col("times")).alias("taken"), F.col("sources")[0].alias("source"), "times")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns."""
    order = Window.partitionBy("doc_id").orderBy("__size", F.col("source").asc_nulls_last())
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(c.WORD)).cast("long")
    rows = docs.withColumn("__size", words).withColumn("__row", F.row_number().over(order).cast("long"))
    times = mix(sized_documents(docs)).where("times > 0").select(
        F.col("doc_id").alias("__doc"), F.col("row").alias("__no"), F.col("times").cast("int").alias("__times"))
    hit = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__row") == F.col("__no"))
    return rows.join(times, hit).withColumn("__each", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(docs.columns)
