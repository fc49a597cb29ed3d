"""Two-parameter item response: patterns, calibration, scores, fit, checks, transfer.

The likelihood depends on a person's response pattern alone. Spark counts patterns and packs them into blocks; a round
of EM adds up, over blocks, how many persons are expected at each node of the trait and how many of them do
each item. Items are then logistic regressions on these sums. Several banks (all groups to hold out, and all but each of them) are
calibrated from one table of patterns: a column of counts per group, and subtraction. If the patterns fit into one task
(``TASK`` blocks), each bank is calibrated in a task of its own; else a round is a job for all banks.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from .frozen import frozen
from .probit import below
from .tables import mean_ranks

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

#: Patterns of a block, blocks of a task; groups of one table.
BLOCK, TASK, MAX_GROUPS = 8192, 8, 256
#: Quadrature of the standard normal trait.
NODES = np.linspace(-4.0, 4.0, 81)
MIN_CASES, MIN_TARGET, TRANSFER_BAR, RANK_BAR, SHARP = 500, 300, 0.95, -0.80, 1.0
MISFIT = (0.5, 1.5)
ROUNDS, TOLERANCE = 500, 1e-5
# Pairs of items (harder, easier) whose order is known.
KNOWN_ORDER = (("grab_bag", "flashlight_candles"), ("training_exercise", "first_aid_kit"), ("neighbourhood_discussion", "emergency_food_drink"))


def prior() -> np.ndarray:
    w = np.exp(-0.5 * NODES**2)
    return w / w.sum()


def patterns(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """(items as int, n): complete cases, counted by pattern."""
    t = df.select(*[F.col(c).cast("int").alias(c) for c in items]).dropna(how="any")
    return t.groupBy(*items).agg(F.count("*").alias("n"))


def likelihoods(x: np.ndarray, slope: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """(patterns, nodes), up to a factor for each pattern."""
    p = 1 / (1 + np.exp(-(NODES[:, None] * slope + cut)))
    log_l = x @ np.log(p).T + (1 - x) @ np.log1p(-p).T
    return np.exp(log_l - log_l.max(1, keepdims=True))


def expected(x: np.ndarray, n: np.ndarray, slope: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """(nodes, 1 + items): persons expected at each node, and those of them who do each item."""
    post = likelihoods(x, slope, cut) * prior()
    post *= (n / post.sum(1))[:, None]
    return np.column_stack([post.sum(0), post.T @ x])


def improved(sums: np.ndarray, slope: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes and intercepts that fit the expected answers best, by Newton's method."""
    design, total, right = np.stack([NODES, np.ones_like(NODES)], 1), sums[:, 0], sums[:, 1:]
    slope, cut = slope.copy(), cut.copy()
    for j in range(len(slope)):
        b = np.array([slope[j], cut[j]])
        for _ in range(10):
            q = 1 / (1 + np.exp(-design @ b))
            grad = design.T @ (right[:, j] - total * q)
            hess = (design * (total * q * (1 - q))[:, None]).T @ design + 1e-9 * np.eye(2)
            step = np.clip(np.linalg.solve(hess, grad), -1, 1)
            b += step
            if np.abs(step).max() < 1e-8:
                break
        slope[j], cut[j] = np.clip(b[0], 0.05, 6), b[1]
    return slope, cut


def begin(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.ones(len(share)), np.log(np.clip(share, 1e-3, 1 - 1e-3) / np.clip(1 - share, 1e-3, 1))


def moved(a: tuple, b: tuple) -> float:
    return float(max(np.abs(p - q).max() for p, q in zip(a, b)))


def fit_banks(counts: DataFrame, items: Sequence[str], weights: dict[str, dict[str, float]], rounds: int = ROUNDS, tolerance: float = TOLERANCE, apart: bool | None = None) -> dict[str, list[dict]]:
    """A bank, rows by difficulty, for each name of ``weights``: its factors of the count columns of ``counts``.

    Marginal maximum likelihood by EM. ``apart`` overrides whether banks have tasks of their own; banks are the same.
    """
    items, names = list(items), list(weights)
    columns = sorted({c for w in weights.values() for c in w})
    factors = np.array([[weights[name].get(c, 0.0) for c in columns] for name in names])
    counts = frozen(counts.select(*[F.col(c).cast("double").alias(c) for c in (*items, *columns)]))
    sums = counts.agg(F.count("*"), *[F.sum(c) for c in columns], *[F.sum(F.col(i) * F.col(c)) for c in columns for i in items]).first()
    cases = factors @ np.array(sums[1 : 1 + len(columns)], float)
    share = factors @ np.array(sums[1 + len(columns) :], float).reshape(len(columns), len(items)) / np.maximum(cases, 1)[:, None]
    width, tasks = len(items), max(1, sums[0] // (BLOCK * TASK))

    def pack(batches):
        for b in batches:
            table = np.column_stack([c.to_numpy() for c in b.columns])
            parts = [table[k : k + BLOCK].tobytes() for k in range(0, len(table), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], names=["cells"])

    def one(r):
        t = np.frombuffer(r.cells, np.float64).reshape(-1, width + len(columns))
        return t[:, :width], t[:, width:] @ factors.T

    blocks = counts.repartition(tasks, *items).mapInArrow(pack, "cells binary").rdd.map(one)
    if tasks == 1 if apart is None else apart:

        def alone(k_blocks):
            k, parts = k_blocks
            x, n = (np.concatenate(a) for a in zip(*parts))
            x, n, at = x[n > 0], n[n > 0], begin(share[k])
            for _ in range(rounds):
                before, at = at, improved(expected(x, n, *at), *at)
                if moved(before, at) < tolerance:
                    break
            return k, at

        own = blocks.flatMap(lambda b: [(k, (b[0], b[1][:, k])) for k in range(len(names))])
        found = dict(own.groupByKey(len(names), lambda k: k).map(alone).collect())
    else:
        blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        found, open_banks = {k: begin(s) for k, s in enumerate(share)}, list(range(len(names)))
        for _ in range(rounds):
            now = {k: found[k] for k in open_banks}
            got = blocks.map(lambda b: np.stack([expected(b[0], b[1][:, k], *at) for k, at in now.items()])).treeReduce(lambda a, b: a + b)  # noqa: B023
            for k, s in zip(now, got):
                found[k] = improved(s, *now[k])
            open_banks = [k for k in open_banks if moved(now[k], found[k]) >= tolerance]
            if not open_banks:
                break
        blocks.unpersist()
    out = {}
    for k, name in enumerate(names):
        bank = [{"item": c, "discrimination": float(a), "difficulty": float(-d / a), "p_observed": float(s), "n_calibration": int(round(cases[k]))} for c, a, d, s in zip(items, *found[k], share[k])]
        out[name] = sorted(bank, key=lambda r: r["difficulty"])
    return out


def fit_2pl(counts: DataFrame, items: Sequence[str], min_cases: int = MIN_CASES, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> list[dict]:
    """The bank of pattern counts (items, n); rows by difficulty."""
    n = counts.agg(F.sum("n")).first()[0] or 0
    if n < min_cases:
        raise ValueError(f"fit_2pl: {int(n)} complete cases, {min_cases} are needed")
    return fit_banks(counts, items, {"all": {"n": 1.0}}, rounds, tolerance)["all"]


def bank_frame(spark: SparkSession, bank: Sequence[dict]) -> DataFrame:
    return spark.createDataFrame([(r["item"], float(r["discrimination"]), float(r["difficulty"]), float(r["p_observed"]), int(r.get("n_calibration", 0))) for r in bank], "item string, discrimination double, difficulty double, p_observed double, n_calibration long")


def eap(counts: DataFrame, bank: Sequence[dict], name: str = "theta") -> DataFrame:
    """``counts`` with each pattern's posterior mean, inside generated code: one expression per node."""
    nodes = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in zip(NODES, prior())])

    def likelihood(t):
        out = F.lit(1.0)
        for r in bank:
            p = 1.0 / (1.0 + F.exp(-float(r["discrimination"]) * (t - float(r["difficulty"]))))
            out = out * F.when(F.col(r["item"]) == 1, p).otherwise(1.0 - p)
        return out

    mass = F.transform(nodes, lambda x: F.struct(x["t"].alias("t"), (x["w"] * likelihood(x["t"])).alias("l")))
    t = counts.withColumn("_mass", mass)
    top = F.aggregate("_mass", F.lit(0.0), lambda a, x: a + x["t"] * x["l"])
    return t.withColumn(name, top / F.aggregate("_mass", F.lit(0.0), lambda a, x: a + x["l"])).drop("_mass")


def score_persons(df: DataFrame, items: Sequence[str], bank: Sequence[dict], name: str = "theta") -> DataFrame:
    """``df`` with each person's score; null where an item is. Patterns are scored once and joined back."""
    keys = [F.col(c).cast("int").alias(f"_k{i}") for i, c in enumerate(items)]
    scored = eap(patterns(df, items), bank, name).select(*keys, name)
    on = [F.col(c).cast("int") == F.col(f"_k{i}") for i, c in enumerate(items)]
    cond = on[0]
    for c in on[1:]:
        cond &= c
    return df.join(scored, cond, "left").drop(*[f"_k{i}" for i in range(len(items))])


def item_fit(counts: DataFrame, bank: Sequence[dict]) -> DataFrame:
    """Infit and outfit of each item at the patterns' scores."""
    t = eap(counts, bank)
    rows = F.array(
        *[
            F.struct(F.lit(r["item"]).alias("item"), F.col(r["item"]).cast("double").alias("x"), (1.0 / (1.0 + F.exp(-float(r["discrimination"]) * (F.col("theta") - float(r["difficulty"]))))).alias("p"))
            for r in bank
        ]
    )
    t = t.select("n", F.explode(rows).alias("r")).select("n", "r.*")
    v = F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-9))
    t = t.withColumn("v", v).withColumn("z2", (F.col("x") - F.col("p")) * (F.col("x") - F.col("p")) / F.col("v"))
    out = t.groupBy("item").agg(
        (F.sum(F.col("n") * F.col("v") * F.col("z2")) / F.sum(F.col("n") * F.col("v"))).alias("infit"),
        (F.sum(F.col("n") * F.col("z2")) / F.sum("n")).alias("outfit"),
        F.sum("n").alias("n"),
    )
    inside = F.col("infit").between(*MISFIT) & F.col("outfit").between(*MISFIT)
    return out.withColumn("misfitting", ~inside)


def _ranks(v: np.ndarray) -> np.ndarray:
    order = np.argsort(v, kind="stable")
    r = np.empty(len(v))
    r[order] = np.arange(1, len(v) + 1)
    return np.array([r[v == x].mean() for x in v])


def face_validity(bank: Sequence[dict]) -> list[dict]:
    """Known orders of difficulty, and that difficulty falls with how often an item is done."""
    b = {r["item"]: r["difficulty"] for r in bank}
    out = [{"check": f"{hard} harder than {easy}", "b_harder": round(b[hard], 3), "b_easier": round(b[easy], 3), "pass": b[hard] > b[easy]} for hard, easy in KNOWN_ORDER if hard in b and easy in b]
    ranks = [_ranks(np.array([r[k] for r in bank], float)) for k in ("difficulty", "p_observed")]
    rho = float(np.corrcoef(*ranks)[0, 1])
    return [*out, {"check": "difficulty ranks against observed frequency", "b_harder": round(rho, 3), "b_easier": None, "pass": rho < RANK_BAR}]


def dimensionality(bank: DataFrame, split: float = SHARP) -> DataFrame:
    """Sharp and flat items: number, mean parameters, names by difficulty. Both rows are always there."""
    sharp = F.col("discrimination") >= split
    names = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("difficulty", "item")))), lambda x: x["item"]), ", ")  # noqa: E731  a bank has a row per item

    def row(label, cond, k):
        return F.struct(F.lit(label).alias("group"), F.col(f"n{k}").alias("n_items"), F.round(f"a{k}", 3).alias("mean_a"), F.round(f"b{k}", 3).alias("mean_b"), F.col(f"i{k}").alias("items"))

    aggs = []
    for k, cond in (("h", sharp), ("l", ~sharp)):
        aggs += [F.count_if(cond).alias(f"n{k}"), F.avg(F.when(cond, F.col("discrimination"))).alias(f"a{k}"), F.avg(F.when(cond, F.col("difficulty"))).alias(f"b{k}"), names(cond).alias(f"i{k}")]
    return bank.agg(*aggs).select(F.inline(F.array(row("high discrimination", sharp, "h"), row("low discrimination", ~sharp, "l"))))


TRANSFER = (
    "target string, n_target long, n_calibration_pooled long, n_calibration_native long, theta_correlation double, theta_rank_correlation double, "
    "difficulty_correlation double, mean_abs_pri_difference double, passes_transfer boolean"
)


def group_patterns(df: DataFrame, items: Sequence[str], group: str) -> tuple[DataFrame, dict[str, str]]:
    """(patterns with a count column for each group and ``n`` for all rows: a written table; column of each group, by name).

    Null groups count in ``n`` alone.
    """
    t = df.select(F.col(group).cast("string").alias("_group"), *[F.col(c).cast("int").alias(c) for c in items]).dropna(how="any", subset=list(items))
    long = frozen(t.groupBy("_group", *items).agg(F.count("*").alias("k")))
    found = sorted(r[0] for r in long.where("_group IS NOT NULL").select("_group").distinct().limit(MAX_GROUPS + 1).collect())
    if len(found) > MAX_GROUPS:
        raise ValueError(f"group_patterns: more than {MAX_GROUPS} groups")
    columns = {g: f"n_{k}" for k, g in enumerate(found)}
    counts = [F.coalesce(F.sum(F.when(F.col("_group") == g, F.col("k"))), F.lit(0)).alias(c) for g, c in columns.items()]
    return frozen(long.groupBy(*items).agg(F.sum("k").alias("n"), *counts)), columns


def scores_by_banks(counts: DataFrame, items: Sequence[str], pairs: dict[str, tuple]) -> DataFrame:
    """(target, n, pooled, native, pri_difference): the patterns of each target that occur, with both banks' scores."""
    items, order = list(items), list(items)
    banks = {}
    for target, (column, *two) in pairs.items():
        both = []
        for bank in two:
            b = {r["item"]: r for r in bank}
            slope = np.array([b[c]["discrimination"] for c in order])
            both.append((slope, -slope * np.array([b[c]["difficulty"] for c in order])))
        banks[target] = column, both
    columns = [c for c, _ in banks.values()]
    t = counts.select(*[F.col(c).cast("double").alias(c) for c in items], *[F.col(c).cast("long").alias(c) for c in columns])

    def run(batches):
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy() for c in items])
            for target, (column, both) in banks.items():
                n = b.column(column).to_numpy()
                own = n > 0
                if own.any():
                    mass = [likelihoods(x[own], *p) * prior() for p in both]
                    # patterns whose scores differ by rounding alone tie
                    theta = [np.round(m @ NODES / m.sum(1), 9) for m in mass]
                    pri = [np.round(100 * below(v), 1) for v in theta]
                    yield pa.RecordBatch.from_pydict({"target": [target] * int(own.sum()), "n": n[own], "pooled": theta[0], "native": theta[1], "pri_difference": np.abs(pri[0] - pri[1])})

    return t.mapInArrow(run, "target string, n long, pooled double, native double, pri_difference double")


def correlation(t: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """(target, name): correlation of two columns of ``t``, weighted by n; sums of differences from the means."""
    mean = t.groupBy("target").agg(*[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(m) for c, m in ((a, "_a"), (b, "_b"))])
    x, y, n = F.col(a) - F.col("_a"), F.col(b) - F.col("_b"), F.col("n")
    out = F.try_divide(F.sum(n * x * y), F.sqrt(F.sum(n * x * x) * F.sum(n * y * y)))
    return t.join(F.broadcast(mean), "target").groupBy("target").agg(out.alias(name))  # a row per target


def transfers(df: DataFrame, items: Sequence[str], group: str, targets: Sequence[str] | None = None, min_target: int = MIN_TARGET, apart: bool | None = None) -> tuple[DataFrame, dict[str, tuple[list, list]]]:
    """(a row per target, its pooled and native bank by name): does a bank of everyone else score a group as its own bank does?

    All groups, or ``targets``, at once: one scan counts patterns, and what a bank leaves out is subtracted. A group
    with fewer than ``min_target`` complete cases has its number of cases and nulls.
    """
    spark = df.sparkSession
    counts, columns = group_patterns(df, items, group)
    chosen = [t for t in (columns if targets is None else map(str, targets)) if t in columns]
    missing = [] if targets is None else [str(t) for t in targets if str(t) not in columns]
    sizes = counts.agg(*[F.sum(columns[t]).alias(columns[t]) for t in chosen]).first() if chosen else {}
    enough = [t for t in chosen if sizes[columns[t]] >= min_target]
    weights = {}
    for t in enough:
        weights[f"pooled {t}"], weights[f"native {t}"] = {"n": 1.0, columns[t]: -1.0}, {columns[t]: 1.0}
    banks = fit_banks(counts, items, weights, apart=apart) if weights else {}
    pairs = {t: (banks[f"pooled {t}"], banks[f"native {t}"]) for t in enough}
    rows = [(t, 0 if t in missing else int(sizes[columns[t]])) for t in [*chosen, *missing]]
    fixed = []
    for t, (pooled, native) in pairs.items():
        d = {r["item"]: r["difficulty"] for r in native}
        b = np.array([[r["difficulty"], d[r["item"]]] for r in pooled]).T
        fixed.append((t, pooled[0]["n_calibration"], native[0]["n_calibration"], float(np.corrcoef(*b)[0, 1])))
    out = spark.createDataFrame(rows, "target string, n_target long").join(F.broadcast(spark.createDataFrame(fixed, "target string, n_calibration_pooled long, n_calibration_native long, difficulty_correlation double")), "target", "left")
    if not pairs:
        t = spark.createDataFrame([], "target string, n long, pooled double, native double, pri_difference double")
    else:
        t = frozen(scores_by_banks(counts, items, {k: (columns[k], *v) for k, v in pairs.items()}))
    ranked = t
    for c in ("pooled", "native"):
        ranks = mean_ranks(t.groupBy("target", F.col(c).alias("v")).agg(F.sum("n").alias("n")), "target")
        ranked = ranked.join(ranks.select("target", F.col("v").alias(c), F.col("rank").alias(f"rank_{c}")), ["target", c])
    difference = t.groupBy("target").agg((F.sum(F.col("n") * F.col("pri_difference")) / F.sum("n")).alias("mean_abs_pri_difference"))
    for more in (correlation(t, "pooled", "native", "theta_correlation"), correlation(ranked, "rank_pooled", "rank_native", "theta_rank_correlation"), difference):
        out = out.join(more, "target", "left")
    out = out.withColumn("passes_transfer", F.col("theta_correlation") > TRANSFER_BAR)
    return out.select(*[c.split()[0] for c in TRANSFER.split(", ")]), pairs


def transfer(df: DataFrame, items: Sequence[str], group: str, target, min_target: int = MIN_TARGET) -> dict:
    """``transfers`` of one group, as a dict with both banks; too few cases are an error."""
    table, pairs = transfers(df, items, group, [target], min_target)
    r = table.first().asDict()
    if str(target) not in pairs:
        raise ValueError(f"transfer: {r['n_target']} complete cases in the target, {min_target} are needed")
    pooled, native = pairs[str(target)]
    return {**r, "pooled": pooled, "native": native}


def difficulty_comparison(spark: SparkSession, pooled: Sequence[dict], native: Sequence[dict]) -> DataFrame:
    """Both banks side by side, by the change in difficulty."""
    a = bank_frame(spark, pooled).select("item", F.col("difficulty").alias("b_pooled"))
    b = bank_frame(spark, native).select("item", F.col("difficulty").alias("b_native"))
    return a.join(F.broadcast(b), "item").withColumn("delta", F.col("b_native") - F.col("b_pooled")).orderBy("delta", "item")


def theta_to_score(theta) -> F.Column:
    return X.percentile_score(theta)
