"""Boosted trees for many small models side by side.

A model is a group of rows: one series, fold, feature set and target. Spark deals the groups out, and each one is fitted in the task
that receives it, so the number of stages depends neither on rounds nor on models. A series holds one row per date, which
bounds a group; `ROWS` guards this, and a larger group raises an error that names the way out.

Features are cut into at most `BINS` quantile bins per group. Trees grow level by level from histograms of gradients; a split
needs `LEAST` rows on either side and a positive gain. Rows without a feature or the target are left out, as are weights
that are missing or not positive.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS, LEAST, ROWS = 64, 20, 1_000_000


@dataclass(frozen=True)
class Trees:
    """Settings of a fit; `loss` is `squared` or `logistic`."""

    rounds: int = 300
    step: float = 0.02
    depth: int = 5
    share: float = 1.0
    loss: str = "squared"
    seed: int = 42
    least: int = LEAST


def binned(x: np.ndarray, train: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Bin number of each value (rows x features); a bin holds values up to its upper edge, a quantile of the
    training rows."""
    out = np.empty(x.shape, np.int64)
    for f in range(x.shape[1]):
        values = np.unique(x[train, f])
        # Few values keep a bin each.
        edges = values[:-1] if len(values) <= bins else np.unique(np.quantile(x[train, f], np.arange(1, bins) / bins, method="inverted_cdf"))
        out[:, f] = np.searchsorted(edges, x[:, f], "left")
    return out


def grown(places: np.ndarray, slope: np.ndarray, weight: np.ndarray, rows: np.ndarray, depth: int, features: int, bins: int, gains: np.ndarray,
          least: int = LEAST) -> np.ndarray:
    """Leaf of every row in one tree fitted to `slope` (per unit of weight) over the training rows `rows`.

    `places` is feature x bins + bin. Per level two histograms over (node, feature, bin) give the gain of every cut.
    """
    node, cells = np.zeros(len(places), np.int64), features * bins
    for level in range(depth):
        nodes = 1 << level
        at = (node[rows, None] * cells + places[rows]).ravel()
        shape = (nodes, features, bins)
        n, w, g = (np.bincount(at, None if v is None else np.repeat(v[rows], features), minlength=nodes * cells).reshape(shape).cumsum(axis=2)
                   for v in (None, weight, weight * slope))
        left, right = w, w[:, :, -1:] - w
        ok = (n >= least) & (n[:, :, -1:] - n >= least) & (left > 0) & (right > 0)
        whole = g[:, :, -1:] ** 2 / np.maximum(w[:, :, -1:], 1e-300)
        gain = np.where(ok, g ** 2 / np.maximum(left, 1e-300) + (g[:, :, -1:] - g) ** 2 / np.maximum(right, 1e-300) - whole, 0.0)
        best = gain.reshape(nodes, cells).argmax(axis=1)
        value = gain.reshape(nodes, cells)[np.arange(nodes), best]
        split = value > 1e-12 * (1.0 + whole[:, 0, 0])
        if not split.any():
            node <<= depth - level
            break
        np.add.at(gains, best[split] // bins, value[split])
        # Nodes without a cut send all rows to the left.
        feature = np.where(split, best // bins, 0)
        cut = np.where(split, best % bins, bins)
        own = places[np.arange(len(places)), feature[node]] - feature[node] * bins
        node = 2 * node + (own > cut[node])
    return node


def boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, train: np.ndarray, trees: Trees) -> tuple[np.ndarray, np.ndarray]:
    """Prediction for every row (a probability with logistic loss) and each feature's share of all gains."""
    features, bins = x.shape[1], BINS
    places = binned(x, train) + np.arange(features) * bins
    mean = np.average(y[train], weights=weight[train])
    logistic = trees.loss == "logistic"
    if logistic:
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
    score = np.full(len(y), np.log(mean / (1 - mean)) if logistic else mean)
    gains, draw, known = np.zeros(features), np.random.default_rng(trees.seed), np.flatnonzero(train)
    for _ in range(trees.rounds):
        p = 1 / (1 + np.exp(-score)) if logistic else score
        curve = np.maximum(p * (1 - p), 1e-9) if logistic else np.ones(len(y))
        slope, mass = (y - p) / curve, weight * curve
        rows = known if trees.share >= 1 else known[draw.random(len(known)) < trees.share]
        if not len(rows):
            continue
        leaf = grown(places, slope, mass, rows, trees.depth, features, bins, gains, trees.least)
        size = 1 << trees.depth
        total = np.bincount(leaf[rows], mass[rows] * slope[rows], size)
        score += trees.step * (total / np.maximum(np.bincount(leaf[rows], mass[rows], size), 1e-300))[leaf]
    return 1 / (1 + np.exp(-score)) if logistic else score, gains / gains.sum() if gains.sum() > 0 else gains


def fits(df: DataFrame, keys: Sequence[str], feats: Sequence[str], target: str, order: str, train: Column, trees: Mapping[object, Trees] | Trees,
         chosen: Mapping[object, Sequence[str]] | None = None, model: str | None = None, weight: str | None = None, importance: bool = False,
         carry: Sequence[str] = (), name: str = "prediction") -> DataFrame:
    """One fit per group of `keys`: predictions for the rows where `train` is false, or with `importance` one row per feature.

    `model` names a key column whose values pick settings from `trees` and features from `chosen` (all of `feats` else).
    """
    carry = list(dict.fromkeys([order, *carry]))
    cols = [*keys, *carry, *[c for c in (target, weight) if c and c not in carry]]
    table = df.select(*[F.col(f"`{c}`") for c in cols], F.array(*[F.col(f"`{f}`").cast("double") for f in feats]).alias("_x"),
                      F.coalesce(train, F.lit(False)).alias("_train"))
    kinds = {f.name: f.dataType for f in table.schema.fields}
    shape = [T.StructField(k, kinds[k]) for k in keys]
    shape += ([T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())] if importance
              else [*[T.StructField(c, kinds[c]) for c in carry], T.StructField(name, T.DoubleType())])
    shape, place = T.StructType(shape), {f: i for i, f in enumerate(feats)}

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) > ROWS:
            raise ValueError(f"{len(group)} rows in one fit: give keys (`by`) that part them, or sample them")
        case = group[model].iloc[0] if model else None
        own = list((chosen or {}).get(case, feats))
        group = group.sort_values(carry, kind="stable")
        x = np.array(group["_x"].tolist(), float).reshape(len(group), len(feats))[:, [place[f] for f in own]]
        y = group[target].to_numpy(float)
        w = group[weight].to_numpy(float) if weight else np.ones(len(group))
        whole = np.isfinite(x).all(axis=1)
        learn = whole & group["_train"].to_numpy(bool) & np.isfinite(y) & np.nan_to_num(w > 0)
        keep = learn | (whole & ~group["_train"].to_numpy(bool))
        group, x, learn = group[keep], x[keep], learn[keep]
        empty = pd.DataFrame({f.name: pd.Series(dtype=object) for f in shape})
        if not learn.any():
            return empty
        settings = trees[case] if isinstance(trees, Mapping) else trees
        seed = settings.seed + zlib.crc32("|".join(str(group[k].iloc[0]) for k in keys).encode())
        out, gains = boosted(x, np.where(learn, y[keep], 0.0), np.where(learn, w[keep], 0.0), learn, Trees(**{**settings.__dict__, "seed": seed}))
        if importance:
            return pd.DataFrame({**{k: group[k].iloc[0] for k in keys}, "feature": own, "importance": gains})[shape.names]
        return group[[*keys, *carry]].assign(**{name: out})[~learn & ~group["_train"].to_numpy(bool)][shape.names]

    return table.groupBy(*keys).applyInPandas(fit, shape)
