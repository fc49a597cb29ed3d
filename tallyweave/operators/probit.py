"""Ordered probit by Newton's method on sums.

With coded predictors the likelihood depends on (outcome, predictors) alone: Spark counts these cells and writes
them, in blocks. Each step is one pass over the blocks that adds up log-likelihood, gradient and Hessian; the driver
sees these sums, never a cell. The likelihood is concave in thresholds and coefficients, so a step that
doesn't raise it is halved until it does.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frozen import frozen

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

MIN_ROWS, MIN_LEVELS, ROUNDS = 200, 3, 50
#: Levels of an outcome and of a categorical predictor; cells of a block, blocks of a task.
MAX_LEVELS, BLOCK, TASK = 256, 16_384, 8

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)


def pdf(x: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def below(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, small values to full relative precision.

    Near zero an integral of the density (Gauss-Legendre), in the tails the continued fraction of Mills' ratio.
    """
    x = np.asarray(x, float)
    out = np.where(x > 0, 1.0, 0.0)
    near = np.abs(x) <= 3
    v = x[near]
    out[near] = 0.5 + (v / 2) * (pdf(v[:, None] * (_NODES + 1) / 2) @ _WEIGHTS)
    far = ~near & (np.abs(x) < 38)
    v = np.abs(x[far])
    ratio = v.copy()
    for k in range(60, 0, -1):
        ratio = v + k / ratio
    tail = pdf(v) / ratio
    out[far] = np.where(x[far] > 0, 1 - tail, tail)
    return out


def between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Probability between two bounds, taken from the side where both are small."""
    flip = low > 0
    return below(np.where(flip, -low, high)) - below(np.where(flip, -high, low))


def sums(values: np.ndarray, rows: np.ndarray, at: dict, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Of a block: log-likelihood, rows whose likeliest level is theirs, gradient and Hessian, flat.

    ``values`` has the outcome's level first; ``at`` says how predictors are made of the others.
    """
    x, y = predictors(values[:, 1:], at), np.searchsorted(at["levels"], values[:, 0])
    cuts = np.concatenate([[-np.inf], alpha, [np.inf]])
    eta = x @ beta
    a, b = cuts[y + 1] - eta, cuts[y] - eta
    p = np.maximum(between(b, a), 1e-300)
    da, db = (np.where(np.isfinite(v), pdf(np.where(np.isfinite(v), v, 0)), 0) / p for v in (a, b))
    k = len(alpha)
    ja, jb = np.zeros((len(y), k + len(beta))), np.zeros((len(y), k + len(beta)))
    i = np.arange(len(y))
    ja[i[y < k], y[y < k]] = 1
    jb[i[y > 0], y[y > 0] - 1] = 1
    ja[:, k:] = jb[:, k:] = -x
    fa, fb = (np.where(np.isfinite(v), v, 0) for v in (a, b))
    ha, hb, hab = rows * (-fa * da - da * da), rows * (fb * db - db * db), rows * da * db
    mixed = (ja * hab[:, None]).T @ jb
    hess = (ja * ha[:, None]).T @ ja + (jb * hb[:, None]).T @ jb + mixed + mixed.T
    grad = ja.T @ (rows * da) - jb.T @ (rows * db)
    shares = np.diff(below(cuts[None, :] - eta[:, None]), axis=1)
    return np.concatenate([[(rows * np.log(p)).sum(), rows[shares.argmax(1) == y].sum()], grad, hess.ravel()])


def predictors(values: np.ndarray, at: dict) -> np.ndarray:
    """Standardised numbers, then a 0/1 column for each level but the first of each category, standardised alike."""
    n = at["numbers"]
    parts = [values[:, :n], *[(values[:, n + k, None] == lv[1:]).astype(float) for k, lv in enumerate(at["categories"])]]
    return ((np.concatenate(parts, 1) - at["mean"]) / at["scale"])[:, at["keep"]]


def levels_of(df: DataFrame, c: str) -> np.ndarray:
    found = sorted(r[0] for r in df.select(c).distinct().limit(MAX_LEVELS + 1).collect())
    if len(found) > MAX_LEVELS:
        raise ValueError(f"ordered probit: {c} has more than {MAX_LEVELS} levels")
    return np.array(found, float)


def fit(df: DataFrame, outcome: str, numeric: Sequence[str], categorical: Sequence[str] = ()) -> dict:
    """Coefficients with p-values, accuracy beside the majority's share, McFadden's pseudo R2.

    Rows with any null are left out. Predicted outcomes are observed levels. Fewer than MIN_LEVELS levels
    or MIN_ROWS rows are an error; so are more than MAX_LEVELS levels of the outcome or a category.
    """
    cols = [outcome, *numeric, *categorical]
    plain = [f"c{k}" for k in range(len(cols))]
    t = df.select(*[F.col(c).cast("double").alias(p) for c, p in zip(cols, plain)]).dropna(how="any")
    cells = frozen(t.groupBy(*plain).agg(F.count("*").cast("double").alias("n_rows")))
    size = cells.groupBy("c0").agg(F.sum("n_rows").alias("n"), F.count("*").alias("cells")).orderBy("c0").limit(MAX_LEVELS + 1).collect()
    levels, share, n = np.array([r.c0 for r in size]), np.array([r.n for r in size]), sum(r.n for r in size)
    if len(levels) < MIN_LEVELS or n < MIN_ROWS:
        raise ValueError(f"ordered probit: {len(levels)} levels and {int(n)} rows; {MIN_LEVELS} and {MIN_ROWS} are needed")
    if len(levels) > MAX_LEVELS:
        raise ValueError(f"ordered probit: {outcome} has more than {MAX_LEVELS} levels")
    share = share / n
    categories = [levels_of(cells, p) for p in plain[1 + len(numeric) :]]
    made = [F.col(p) for p in plain[1 : 1 + len(numeric)]] + [(F.col(p) == float(v)).cast("double") for p, lv in zip(plain[1 + len(numeric) :], categories) for v in lv[1:]]
    names = [*numeric, *[f"{c}_{v:g}" for c, lv in zip(categorical, categories) for v in lv[1:]]]
    w = F.col("n_rows")
    mean = np.array(cells.agg(*[F.sum(w * c) for c in made]).first(), float) / n if made else np.zeros(0)
    spread = np.array(cells.agg(*[F.sum(w * (c - float(m)) * (c - float(m))) for c, m in zip(made, mean)]).first(), float) if made else np.zeros(0)
    scale = np.sqrt(spread / n)
    keep = np.flatnonzero(scale > 1e-12 * np.maximum(1, np.abs(mean)))
    at = {"numbers": len(numeric), "categories": categories, "levels": levels, "mean": mean, "scale": np.where(scale > 0, scale, 1), "keep": keep}
    tasks = max(1, sum(r.cells for r in size) // (BLOCK * TASK))

    def pack(batches):
        for b in batches:
            table = np.column_stack([c.to_numpy() for c in b.columns])
            parts = [table[k : k + BLOCK] for k in range(0, len(table), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in parts], pa.binary())], names=["cells"])

    width = len(cols) + 1
    blocks = cells.repartition(tasks, *plain).mapInArrow(pack, "cells binary").rdd
    blocks = blocks.map(lambda r: np.frombuffer(r.cells, np.float64).reshape(-1, width)).persist(StorageLevel.MEMORY_AND_DISK)
    k = len(levels) - 1

    def total(theta):
        alpha, beta = theta[:k], theta[k:]
        got = blocks.map(lambda c: sums(c[:, :-1], c[:, -1], at, alpha, beta)).treeReduce(lambda a, b: a + b)
        p = len(theta)
        return got[0], got[1], got[2 : 2 + p], got[2 + p :].reshape(p, p)

    start = [NormalDist().inv_cdf(min(max(s, 1e-6), 1 - 1e-6)) for s in np.cumsum(share)[:-1]]
    theta = np.concatenate([start, np.zeros(len(keep))])
    value, hits, grad, hess = total(theta)
    for _ in range(ROUNDS):
        step = np.linalg.lstsq(-hess, grad, rcond=1e-12)[0]
        if grad @ step < 1e-10 * max(1.0, abs(value)):
            break
        size = 1.0
        while size > 1e-8:
            new = theta + size * step
            if (np.diff(new[:k]) > 0).all() and (found := total(new))[0] >= value:
                break
            size /= 2
        else:
            break
        theta, (value, hits, grad, hess) = new, found
    blocks.unpersist()
    null = float(n * (share * np.log(share)).sum())
    beta, se = theta[k:], np.sqrt(np.maximum(np.diag(np.linalg.pinv(-hess)), 0))[k:]
    table = []
    for j, b, s in zip(keep, beta, se):
        z = b / s if s > 0 else float("nan")
        p_value = math.erfc(abs(z) / math.sqrt(2)) if s > 0 else float("nan")
        table.append({"term": names[j], "coef": float(b / scale[j]), "std_err": float(s / scale[j]), "z": float(z), "p_value": p_value, "significant": p_value < 0.05})
    table.sort(key=lambda r: -abs(r["z"]))
    thresholds = (theta[:k] + (mean[keep] * beta / scale[keep]).sum()).tolist()
    accuracy = float(hits / n)
    return {"n": int(n), "accuracy": accuracy, "baseline": float(share.max()), "lift": accuracy - float(share.max()), "pseudo_r2": float(1 - value / null), "thresholds": thresholds, "levels": levels.tolist(), "coefficients": table}


def summary(fits: dict[str, dict]) -> list[dict]:
    """A row per fitted outcome, four decimals, and whether it beats the majority."""
    keys = ("accuracy", "baseline", "lift", "pseudo_r2")
    return [{"domain": d, "n": f["n"], **{k: round(f[k], 4) for k in keys}, "beats_baseline": f["lift"] > 0} for d, f in fits.items()]


def best_domain(fits: dict[str, dict]) -> dict:
    """The summary of the outcome that beats its majority by most; the first in order of name among equals."""
    return max(summary(dict(sorted(fits.items()))), key=lambda r: r["lift"])
