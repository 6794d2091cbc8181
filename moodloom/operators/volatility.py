"""Exponential volatility models fitted by maximum likelihood at every date, from earlier rows only.

log variance:  h[t] = omega + alpha * (|z[t-1]| - sqrt(2/pi)) + beta * h[t-1],  r[t] = mu + exp(h[t]/2) * z[t]
z follows a skewed Student t with mean 0 and variance 1 (tail weight `eta`, skew `lam`).

Spark hands one block of neighbouring dates of one series, with all rows before its last date, to a task. There
all dates of the block are fitted side by side: one pass over the rows gives the likelihood of many parameter
points at once, as columns of an array.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import names
from .joining import by_block, expanding_blocks

PARAMS = ("mu", "omega", "alpha", "beta", "eta", "lam")
MEAN_ABS = math.sqrt(2.0 / math.pi)
CHUNK = 32
STEPS = np.array([2.0, 1.0, 0.5, 0.2, 0.05, 0.01, 1e-3])
ROUNDS = 200
TOLERANCE = 1e-4
MESH = 1e-3


def natural(theta: np.ndarray) -> np.ndarray:
    """Unbounded columns (mean, long-run log variance, alpha, persistence, tail, skew) as model parameters.

    Persistence stays below 0.9995, `eta` between 2.05 and 300, `lam` within 0.99.
    """
    beta = 0.9995 * np.tanh(theta[:, 3])
    eta = 2.05 + 297.95 / (1.0 + np.exp(-np.clip(theta[:, 4], -30.0, 30.0)))
    return np.stack([theta[:, 0], (1.0 - beta) * theta[:, 1], theta[:, 2], beta, eta,
                     0.99 * np.tanh(theta[:, 5])], axis=1)


def skewed_t(eta: np.ndarray, lam: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Constants of the standardised skewed t: location a, scale b, log of the density's factor."""
    log_c = np.array([math.lgamma((e + 1.0) / 2.0) - math.lgamma(e / 2.0) for e in eta]) \
        - 0.5 * np.log(np.pi * (eta - 2.0))
    a = 4.0 * lam * np.exp(log_c) * (eta - 2.0) / (eta - 1.0)
    b = np.sqrt(1.0 + 3.0 * lam**2 - a**2)
    return a, b, np.log(b) + log_c


def log_density(z: np.ndarray, eta: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """Log density of standardised values, one parameter pair per column."""
    a, b, factor = skewed_t(eta, lam)
    y = b * z + a
    y /= 1.0 + lam * np.sign(y)
    y *= y
    y /= eta - 2.0
    return factor - 0.5 * (eta + 1.0) * np.log1p(y)


def first_variance(r: np.ndarray) -> float:
    """Log variance before the first row: squared deviations weighted by 0.94 to the power of the row."""
    weights = 0.94 ** np.arange(len(r))
    return math.log(max(float(weights @ (r - r.mean()) ** 2 / weights.sum()), 1e-12))


def walk(theta: np.ndarray, r: np.ndarray, before: float):
    """Yield (first row, log variances, log densities) of chunks of rows, one parameter point per column.

    Log variances hold one row more than densities in the last chunk: the forecast after the last row.
    """
    mu, omega, alpha, beta, eta, lam = natural(theta).T
    shift, low, high = omega - alpha * MEAN_ABS, before - 15.0, before + 15.0
    h = np.clip(omega + beta * before, low, high)
    work = np.empty(len(theta))
    for at in range(0, max(len(r), 1), CHUNK):
        part = r[at:at + CHUNK]
        logs, z = np.empty((len(part) + 1, len(theta))), part[:, None] - mu
        for i in range(len(part)):
            logs[i] = h
            np.multiply(h, -0.5, out=work)
            np.exp(work, out=work)
            z[i] *= work
            np.abs(z[i], out=work)
            work *= alpha
            h *= beta
            h += work
            h += shift
            np.maximum(h, low, out=h)
            np.minimum(h, high, out=h)
        logs[-1] = h
        last = at + CHUNK >= len(r)
        yield at, logs if last else logs[:-1], log_density(z, eta, lam) - 0.5 * logs[:-1]


def likelihoods(theta: np.ndarray, r: np.ndarray, before: float, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of the first `ends` rows and log variance of the row after them, per parameter point."""
    total, ahead, columns = np.zeros(len(theta)), np.empty(len(theta)), np.arange(len(theta))
    for at, logs, density in walk(theta, r[:ends.max()], before):
        if at + len(density) <= ends.min():
            total += density.sum(axis=0)
        else:
            total += np.where(np.arange(at, at + len(density))[:, None] < ends, density, 0.0).sum(axis=0)
        here = (ends >= at) & (ends < at + len(logs))
        ahead[here] = logs[ends[here] - at, columns[here]]
    return np.nan_to_num(total, nan=-np.inf), ahead


def running_likelihoods(theta: np.ndarray, r: np.ndarray, before: float, ends: np.ndarray) -> np.ndarray:
    """Log likelihood of every parameter point (column) at every end (row), in one pass; `ends` ascend."""
    out, total = np.empty((len(ends), len(theta))), np.zeros(len(theta))
    for at, _, density in walk(theta, r[:ends[-1]], before):
        sums = total + np.cumsum(density, axis=0)
        here = (ends > at) & (ends <= at + len(density))
        out[here] = sums[ends[here] - at - 1]
        total = sums[-1]
    return np.nan_to_num(out, nan=-np.inf)


def start_points(r: np.ndarray) -> np.ndarray:
    """Grid of starting points around the mean and variance of the rows before a block."""
    level = math.log(max(float(r.var()), 1e-12))
    axes = np.meshgrid([0.0, 0.05, 0.15, 0.3], np.arctanh(np.array([0.3, 0.8, 0.95, 0.985]) / 0.9995),
                       [-4.6, -3.0], [-0.12, 0.0, 0.12], [level - 0.4, level, level + 0.4], indexing="ij")
    alpha, beta, tail, skew, long_run = [a.ravel() for a in axes]
    return np.stack([np.full(len(alpha), r.mean()), long_run, alpha, beta, tail, skew], axis=1)


def climb(theta: np.ndarray, value: np.ndarray, r: np.ndarray, before: float, ends: np.ndarray,
          scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quasi-Newton ascent of all points at once, each on its own rows. Returns points, values and convergence.

    A point converges when the ascent its model promises is below `TOLERANCE`; values never fall.
    """
    theta, value, done = theta.copy(), value.copy(), np.zeros(len(theta), dtype=bool)
    live = np.flatnonzero(np.isfinite(value))
    size = theta.shape[1]
    eye = np.eye(size)
    inverse = eye[None] * (1.0 / ends)[:, None, None]
    fresh = np.ones(len(theta), dtype=bool)

    def slopes(at):
        shifts = np.concatenate([eye, -eye]) * 1e-4
        points = (theta[at][:, None, :] + (shifts * scale)[None]).reshape(-1, size)
        found = likelihoods(points, r, before, np.repeat(ends[at], 2 * size))[0].reshape(-1, 2, size)
        return np.nan_to_num((found[:, 0] - found[:, 1]) / 2e-4, nan=0.0, posinf=0.0, neginf=0.0)

    gradient = np.zeros_like(theta)
    gradient[live] = slopes(live)
    for _ in range(ROUNDS):
        promise = np.einsum("ki,kij,kj->k", gradient[live], inverse[live], gradient[live]) / 2.0
        finished = (promise < TOLERANCE) & ~((promise <= 0) & ~fresh[live])
        done[live[finished]] = True
        live = live[~finished]
        if not len(live):
            break
        step = np.einsum("kij,kj->ki", inverse[live], gradient[live])
        step /= np.maximum(np.abs(step).max(axis=1, keepdims=True), 1.0)
        tries = theta[live][:, None, :] + STEPS[None, :, None] * (step * scale)[:, None, :]
        found = likelihoods(tries.reshape(-1, size), r, before, np.repeat(ends[live], len(STEPS)))[0].reshape(-1, len(STEPS))
        best = found.argmax(axis=1)
        top = found[np.arange(len(live)), best]
        better = top > value[live]
        stuck = live[~better]
        # A point whose own model finds no ascent starts again from the plain gradient, and rests if that fails too.
        resting = stuck[fresh[stuck]]
        inverse[stuck], fresh[stuck] = eye / ends[stuck][:, None, None], True
        up = live[better]
        moved = STEPS[best[better]][:, None] * step[better]
        theta[up] = tries[better, best[better]]
        value[up] = top[better]
        old = gradient[up]
        if len(up):
            gradient[up] = slopes(up)
            bend = old - gradient[up]
            along = (moved * bend).sum(axis=1)
            good = along > 1e-10 * np.linalg.norm(moved, axis=1) * np.linalg.norm(bend, axis=1)
            rho = np.where(good, 1.0 / np.where(good, along, 1.0), 0.0)[:, None, None]
            left = eye[None] - rho * moved[:, :, None] * bend[:, None, :]
            update = left @ inverse[up] @ left.transpose(0, 2, 1) + rho * moved[:, :, None] * moved[:, None, :]
            inverse[up] = np.where(good[:, None, None], update, inverse[up])
            fresh[up] = False
        live = live[~np.isin(live, resting)]
    return theta, value, done


def search(theta: np.ndarray, value: np.ndarray, r: np.ndarray, before: float, ends: np.ndarray,
           scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascent without slopes, for points that rest on an edge of the likelihood (it has one wherever a return equals `mu`).

    Each round tries a step along both ends of the axes and of a rotation of them. The step grows after a success, halves after
    a failure, and the point converges when no step down to `MESH` is likelier. Rotations depend on the round alone.
    """
    theta, value, done = theta.copy(), value.copy(), ~np.isfinite(value)
    size, width, draws = theta.shape[1], np.full(len(theta), 0.1), np.random.default_rng(0)
    for _ in range(ROUNDS):
        live = np.flatnonzero(~done)
        turned = np.linalg.qr(draws.normal(size=(size, size)))[0]
        if not len(live):
            break
        sides = np.concatenate([np.eye(size), -np.eye(size), turned, -turned])
        tries = theta[live][:, None, :] + (sides * scale)[None] * width[live][:, None, None]
        found = likelihoods(tries.reshape(-1, size), r, before, np.repeat(ends[live], len(sides)))[0].reshape(-1, len(sides))
        best = found.argmax(axis=1)
        top = found[np.arange(len(live)), best]
        up = top > value[live] + TOLERANCE / 10.0
        theta[live[up]], value[live[up]] = tries[up, best[up]], top[up]
        width[live] *= np.where(up, 1.5, 0.5)
        done[live] = width[live] < MESH
    return theta, value, done & np.isfinite(value)


def fit_dates(r: np.ndarray, first: int, last: int, min_obs: int) -> pd.DataFrame:
    """Fits for rows `first` to `last` (exclusive), row t from the rows before it; values in percent.

    A date starts at the best of a grid of points, climbs, and climbs again from the optimum of an earlier date of the
    block where that is likelier on its own rows. Nothing later than a date enters its fit.
    """
    ends = np.arange(first, last)
    columns = ["sigma", "loglik", "converged", *PARAMS]
    if not len(ends) or float(r[:min_obs].var()) <= 1e-12:
        return pd.DataFrame({c: np.full(len(ends), False if c == "converged" else np.nan) for c in columns})
    before, known = first_variance(r[:min_obs]), r[:first]
    scale = np.array([max(float(known.std()), 1e-6), 1.0, 0.5, 1.0, 1.0, 1.0])
    points = start_points(known)
    values = running_likelihoods(points, r, before, ends)
    best = values.argmax(axis=1)
    theta, value, done = climb(points[best], values[np.arange(len(ends)), best], r, before, ends, scale)
    shared = np.where(np.tri(len(ends), dtype=bool), running_likelihoods(theta, r, before, ends), -np.inf)
    best = shared.argmax(axis=1)
    top = shared[np.arange(len(ends)), best]
    again = np.flatnonzero((top > value + TOLERANCE) | ~done)
    if len(again):
        start = np.where((top > value)[again, None], theta[best[again]], theta[again])
        theta[again], value[again], done[again] = climb(
            start, np.maximum(top, value)[again], r, before, ends[again], scale)
    rest = np.flatnonzero(~done)
    if len(rest):
        theta[rest], value[rest], done[rest] = search(theta[rest], value[rest], r, before, ends[rest], scale)
    ahead = likelihoods(theta, r, before, ends)[1]
    out = pd.DataFrame(natural(theta), columns=list(PARAMS))
    out.insert(0, "sigma", np.exp(0.5 * ahead) / 100.0)
    out.insert(1, "loglik", value)
    out.insert(2, "converged", done)
    return out


def egarch_fits(df: DataFrame, ret: str, min_obs: int = 60, order: str = "date", by=None, block: int = 128) -> DataFrame:
    """One row per date from row `min_obs` on: volatility forecast, likelihood, convergence and parameters.

    Missing returns count as 0. A series whose first `min_obs` returns do not vary has no fit: NULL values, not converged.
    `converged` says whether the ascent ended at an optimum, so that dates without one can be counted.
    """
    keys = names(by)
    slim = df.select(*keys, order, F.coalesce(F.col(ret).cast("double"), F.lit(0.0)).alias("_ret"))
    types = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in [*keys, order]] + ["sigma double", "loglik double", "converged boolean"]
                       + [f"{p} double" for p in PARAMS])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos").reset_index(drop=True)
        start = int(pdf["_block"].iloc[0]) * block
        first, last = max(start, min_obs), min(start + block, len(pdf))
        found = fit_dates(pdf["_ret"].to_numpy(dtype=float) * 100.0, first, last, min_obs)
        dates = pdf[[*keys, order]].iloc[first:last].reset_index(drop=True)
        return pd.concat([dates, found], axis=1)

    fitted = by_block(expanding_blocks(slim, order, min_obs, block, keys), keys).applyInPandas(fit, schema)
    plain = {c: F.when(~F.isnan(c), F.col(c)) for c in ["sigma", "loglik", *PARAMS]}
    return fitted.withColumns(plain)
