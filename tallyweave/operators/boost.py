"""Boosted driver models: leakage guard, grouped folds, baselines, Shapley importance.

Trees grow by the leaf that gains most, on histograms. Features are coded once into ``BINS`` bins, one of them for
missing values, which take the branch that gains more. Rows with equal codes and fold are one cell (rows, sum of
the target): with squared error and no row sampling, sums over cells are sums over rows. Cells lie in blocks, in as many
partitions as there is work for. If that is one, as for coded surveys of any number of rows, each model (of all folds and feature
sets) grows in a task of its own. Else a round grows a tree of every model at once: a job adds up the
histograms of the leaves that may be split next, of all models, and the driver, which sees sums by leaf, feature and
bin and no cell, chooses splits. Growing 31 leaves takes about as many jobs as a tree is deep.

What the trees so far predict for a block is kept by the workers that met it; a worker that has not catches up from the trees
since the last table of predictions, which is written every ``SAVE`` rounds.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frozen import frozen

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

# What the target is made of, and the features.
LEAKY = ("act_", "n_actions", "pri", "theta_", "pgi", "took_any_action")
BARRIERS = (
    "prep_no_time_or_money",
    "prep_needs_more_info",
    "prep_prep_helps_cope",
    "prep_knows_what_to_do",
    "prep_knows_alert_channel",
    "prep_prep_info_easy",
    "prep_employer_encourages",
    "prep_services_encourage",
    "prep_feels_well_prepared",
)
INFORMATION = ("info_feels_informed", "info_trusts_official_info", "info_info_easy_to_find", "info_knows_where_abroad")
CONTEXT = ("no_disaster_experience", "n_disasters_experienced", "top_personal_risk", "trusts_emergency_services", "volunteers_for_responders")
DEMOGRAPHICS = ("age", "gender", "community_type", "bill_difficulties", "social_class")
CATEGORICAL = ("gender", "community_type", "social_class", "top_personal_risk", "country_grouped")
MAX_FOLDS = 5
#: Codes of a feature: 0 for a missing value, the last for categories beyond the most frequent ones.
BINS = 64
RATE, LEAVES, MIN_ROWS, FEATURE_SHARE, ROUNDS, SEED = 0.05, 31, 40, 0.8, 400, 42
#: Cells of a block, blocks of a task, rounds between two tables of predictions.
BLOCK, TASK, SAVE = 16_384, 8, 50


def no_leakage(features: Sequence[str]) -> None:
    bad = [f for f in features if f.startswith(LEAKY)]
    if bad:
        raise ValueError(f"features made from what the target is made of: {', '.join(bad)}")


def folds(df: DataFrame, group: str, k: int = MAX_FOLDS) -> dict:
    """Group to fold: the largest group first, into the smallest fold. Groups are few (countries)."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).collect()
    k = min(k, len(sizes))
    load, out = [0] * k, {}
    for r in sizes:
        at = load.index(min(load))
        out[r[group]] = at
        load[at] += r["n"]
    return out


# Codes


def coding(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[str, list]]:
    """Each feature's kind and bounds: ascending upper ends of bins of a number (its values, if they are few, else
    quantiles), or the categories. At most BINS of each come to the driver."""
    numbers = [f for f in features if f not in CATEGORICAL]
    out = {}
    if numbers:
        value = {f: F.col(f).cast("double") for f in numbers}
        most = BINS - 1
        size = df.agg(*[F.approx_count_distinct(v).alias(f) for f, v in value.items()]).first()
        few = [f for f in numbers if size[f] <= 2 * most]
        found = df.agg(*[(F.array_sort(F.collect_set(value[f])) if f in few else F.percentile_approx(value[f], [k / most for k in range(1, most)], 100 * BINS)).alias(f) for f in numbers]).first()
        for f in numbers:
            ends = sorted(set(found[f] or []))
            if f in few and len(ends) > most:
                ends = [ends[len(ends) * k // most] for k in range(1, most)]
            elif f in few:
                ends = ends[:-1]
            out[f] = "number", ends
    for f in (f for f in features if f in CATEGORICAL):
        c = F.col(f).cast("string")
        top = df.where(c.isNotNull()).groupBy(c.alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c").limit(BINS - 2).collect()
        out[f] = "category", [r["c"] for r in top]
    return {f: out[f] for f in features}


def code(f: str, kind: str, bounds: list) -> F.Column:
    """The bin of a value: of a number 1 + the bounds below it, of a category its place."""
    if kind == "number":
        v = F.col(f).cast("double")
        at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < v)) + 1 if bounds else F.lit(1)
        return F.when(v.isNull() | F.isnan(v), 0).otherwise(at)
    places = [x for k, c in enumerate(bounds) for x in (F.lit(c), F.lit(k + 1))]
    found = F.try_element_at(F.create_map(*places), F.col(f).cast("string")) if places else F.lit(None).cast("int")
    return F.when(F.col(f).isNull(), 0).otherwise(F.coalesce(found, F.lit(BINS - 1)))


@dataclass
class Design:
    """Coded rows (y, fold, x), equal ones counted (y, fold, x, n; written), their cells in blocks, and the sums of each fold: rows, target."""

    features: list[str]
    rows: DataFrame
    counted: DataFrame
    blocks: DataFrame
    tasks: int
    sums: dict[int, tuple[float, float]]
    categorical: np.ndarray


BLOCKS = "n int, x binary, fold binary, rows binary, total binary"


def design(df: DataFrame, features: Sequence[str], target: str, group: str) -> Design:
    """Rows with a target and a group, coded; cells of equal codes and fold."""
    no_leakage(features)
    features = list(features)
    t = df.where(F.col(target).isNotNull() & F.col(group).isNotNull())
    at = folds(t, group)
    if not at:
        raise ValueError("design: no rows with a target and a group")
    fold = F.create_map(*[F.lit(x) for kv in at.items() for x in kv])[F.col(group)]
    codes = coding(t, features)
    rows = t.select(F.col(target).cast("double").alias("y"), fold.cast("int").alias("fold"), F.array(*[code(f, *codes[f]).cast("int") for f in features]).alias("x"))
    counted = frozen(rows.groupBy("y", "fold", "x").agg(F.count("*").cast("double").alias("n")))
    cells = frozen(counted.groupBy("fold", "x").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("total")))
    # folds are few
    per_fold = cells.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count("*").alias("cells")).collect()
    width, tasks = len(features), max(1, sum(r["cells"] for r in per_fold) // (BLOCK * TASK))

    def pack(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().astype(np.uint8).reshape(-1, width)
            own, n, total = b.column(0).to_numpy().astype(np.uint8), b.column(2).to_numpy(), b.column(3).to_numpy()
            for k in range(0, len(x), BLOCK):
                part = [np.ascontiguousarray(a[k : k + BLOCK]) for a in (x, own, n, total)]
                yield pa.RecordBatch.from_pylist([{"n": len(part[0]), **{c: a.tobytes() for c, a in zip(("x", "fold", "rows", "total"), part)}}], pa.schema([("n", pa.int32()), ("x", pa.binary()), ("fold", pa.binary()), ("rows", pa.binary()), ("total", pa.binary())]))

    blocks = frozen(cells.repartition(tasks, "x").mapInArrow(pack, BLOCKS))
    return Design(features, rows, counted, blocks, tasks, {r["fold"]: (r["n"], r["total"]) for r in per_fold}, np.array([codes[f][0] == "category" for f in features]))


# Trees


class Tree:
    """Splits in the order they were made (node, feature, whether each code goes left, left, right); value and rows of every node."""

    def __init__(self, splits=(), value=(), rows=()):
        self.splits, self.value, self.rows = list(splits), list(value), list(rows)

    def __reduce__(self):
        # tasks get some hundreds of them: as a few arrays
        nodes = np.array([(s[0], s[1], s[3], s[4]) for s in self.splits], np.int16).reshape(-1, 4)
        left = np.packbits(np.array([s[2] for s in self.splits], bool).reshape(-1, BINS), axis=1)
        return Tree.of, (nodes, left, np.array(self.value), np.array(self.rows))

    @staticmethod
    def of(nodes, left, value, rows) -> "Tree":
        tables = np.unpackbits(left, axis=1).astype(bool)
        return Tree([(int(a), int(f), t, int(l), int(r)) for (a, f, l, r), t in zip(nodes, tables)], value.tolist(), rows.tolist())

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int32)
        for node, f, left, l, r in self.splits:
            here = np.flatnonzero(at == node)
            at[here] = np.where(left[x[here, f]], l, r)
        return at

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(x)]

    def paths(self) -> list[tuple[float, dict, dict]]:
        """(value, share of rows that follow the path by feature, codes that do by feature) of each leaf."""
        found = {0: ({}, {})}
        for node, f, left, l, r in self.splits:
            shares, codes = found.pop(node)
            for child, table in ((l, left), (r, ~left)):
                share = self.rows[child] / self.rows[node]
                found[child] = ({**shares, f: shares.get(f, 1.0) * share}, {**codes, f: codes.get(f, True) & table})
        return [(self.value[leaf], *p) for leaf, p in found.items()]


@dataclass
class Model:
    """A boosted model over coded rows: its start, its trees, what splits on each feature gained."""

    features: list[str]
    start: float
    trees: list = field(default_factory=list)
    gain: np.ndarray | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t in self.trees:
            out += t(x)
        return out


def best_splits(hist: np.ndarray, allowed: np.ndarray, categorical: np.ndarray, min_rows: int) -> list[tuple]:
    """(gain, feature, whether each code goes left) of each node's best split on its ``allowed`` features; hist is (nodes, features, codes, (rows, residuals)).

    Numbers are cut in order, with missing values first or last; categories in order of their means. Of splits that
    gain alike to nine digits, the first in order of feature, place of missing values and cut is taken.
    """
    nodes, width = hist.shape[:2]
    n, g = hist[..., 0], hist[..., 1]
    first = np.broadcast_to(np.arange(BINS), n.shape)
    by_mean = np.argsort(np.where(n > 0, np.round(g / np.maximum(n, 1), 12), np.inf), axis=2, kind="stable")
    orders = [np.where(categorical[None, :, None], by_mean, o) for o in (first, np.roll(first, -1, 2))]
    order = np.stack(orders, 2)
    left_n, left_g = (np.cumsum(np.take_along_axis(np.broadcast_to(a[:, :, None], order.shape), order, 3), 3)[..., :-1] for a in (n, g))
    all_n, all_g = n[:, 0].sum(1)[:, None, None, None], g[:, 0].sum(1)[:, None, None, None]
    right_n, right_g = all_n - left_n, all_g - left_g
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_g**2 / left_n + right_g**2 / right_n - all_g**2 / all_n
    gain = np.where((left_n >= min_rows) & (right_n >= min_rows) & allowed[:, :, None, None], gain, -np.inf)
    flat = gain.reshape(nodes, -1)
    best = flat.max(1)
    out = []
    for k in range(nodes):
        if not np.isfinite(best[k]):
            out.append((-np.inf, -1, None))
            continue
        at = int(np.argmax(flat[k] >= best[k] - 1e-9 * abs(best[k])))
        f, v, cut = np.unravel_index(at, gain.shape[1:])
        left = np.zeros(BINS, bool)
        left[order[k, f, v, : cut + 1]] = True
        out.append((float(best[k]), int(f), left))
    return out


_KNOWN: dict = {}  # of a worker: (run, saved rounds, block) -> (rounds, predictions)


def predictions(run: str, block: tuple, starts: np.ndarray, saved: int, trees: list[list[Tree]]) -> np.ndarray:
    """(models, cells): what the trees so far predict; ``trees`` are those since round ``saved``, whose predictions the block has."""
    number, x, *_, base = block
    rounds, out = _KNOWN.get((run, saved, number), (saved, None))
    if out is None:
        out = np.repeat(starts[:, None], len(x), 1) if base is None else base.copy()
    for step in trees[rounds - saved :]:
        for m, tree in enumerate(step):
            if tree is not None:
                out[m] += tree(x)
    if len(_KNOWN) > 4 * TASK:
        _KNOWN.clear()
    _KNOWN[run, saved, number] = saved + len(trees), out
    return out


def add_block(total: np.ndarray, block: tuple, scores: np.ndarray, outs: list, asked: list) -> None:
    """Add a block's part of the histograms asked for: (asked nodes, features, codes, (rows, residuals)).

    ``asked`` has, for each model, (tree so far, [(node, split of it or None), ...]): the rows of the node, or of
    its left side. ``outs`` is the fold that each model leaves out.
    """
    _, x, fold, rows, target, _ = block
    at = 0
    for m, (tree, nodes) in enumerate(asked):
        if not nodes:
            continue
        leaf, slot = tree.leaf_of(x), np.full(len(x), -1)
        for k, (node, split) in enumerate(nodes):
            slot[(leaf == node) if split is None else (leaf == node) & split[1][x[:, split[0]]]] = k
        use = np.flatnonzero((slot >= 0) & (fold != outs[m]))
        n, res = rows[use], target[use] - rows[use] * scores[m, use]
        for f in range(x.shape[1]):
            place = slot[use] * BINS + x[use, f]
            for k, w in enumerate((n, res)):
                total[at : at + len(nodes), f, :, k] += np.bincount(place, w, len(nodes) * BINS).reshape(-1, BINS)
        at += len(nodes)


def histograms(blocks, run: str, starts: np.ndarray, outs: list, saved: int, trees: list, asked: list) -> np.ndarray:
    """The histograms asked for, over all blocks: a job."""
    most = sum(len(nodes) for _, nodes in asked)

    def partial(part):
        total = None
        for block in part:
            if total is None:
                total = np.zeros((most, block[1].shape[1], BINS, 2))
            add_block(total, block, predictions(run, block, starts, saved, trees), outs, asked)
        if total is not None:
            yield total

    return blocks.mapPartitions(partial).treeReduce(lambda a, b: a + b)


class Growing:
    """A tree under way: open leaves (histogram, best split), and ahead of time their children (as many, both)."""

    def __init__(self, root: np.ndarray, split: tuple):
        self.tree, self.open, self.ahead, self.gain = Tree(), {0: (root, split)}, {}, np.zeros(len(root))
        self.node(root)

    def node(self, hist: np.ndarray) -> int:
        n, g = hist[0].sum(0)
        self.tree.rows.append(float(n))
        self.tree.value.append(float(g / n) if n else 0.0)
        return len(self.tree.value) - 1

    def by_gain(self, least: float) -> list[int]:
        """Open leaves that a split improves, the best first."""
        return [node for _, node in sorted((-s[0], node) for node, (_, s) in self.open.items() if s[0] > least)]

    def grow(self, leaves: int, least: float) -> None:
        """Split the leaf that gains most, as long as its children are known."""
        while len(self.open) < leaves and (best := self.by_gain(least)[:1]) and best[0] in self.ahead:
            gain, f, left = self.open.pop(best[0])[1]
            children = self.ahead.pop(best[0])
            l, r = (self.node(hist) for hist, _ in children)
            self.open |= zip((l, r), children)
            self.tree.splits.append((best[0], f, left, l, r))
            self.gain[f] += gain

    def wanted(self, leaves: int, least: float) -> list[int]:
        """Leaves whose children may be needed: the best for which there is room."""
        return [node for node in self.by_gain(least)[: leaves - len(self.open)] if node not in self.ahead]


@dataclass(frozen=True)
class Options:
    iterations: int = ROUNDS
    leaves: int = LEAVES
    min_rows: int = MIN_ROWS
    rate: float = RATE
    feature_share: float = FEATURE_SHARE
    seed: int = SEED


def boost(models: list[Model], use: np.ndarray, categorical: np.ndarray, o: Options, ask, after) -> None:
    """Grow ``o.iterations`` trees of every model, side by side.

    ``use`` says which features a model has; ``ask`` returns histograms, and ``after`` hears of the trees of a round.
    """
    rng, least = np.random.default_rng(o.seed), None
    for _ in range(o.iterations):
        # features of a tree: one draw, so that a model is the same whichever others grow beside it
        draw, picked = rng.random(use.shape[1]), np.zeros(use.shape, bool)
        for m, own in enumerate(map(np.flatnonzero, use)):
            picked[m, own[np.argsort(draw[own])][: max(1, int(len(own) * o.feature_share + 0.5))]] = True
        root = ask([(Tree(), [(0, None)])] * len(models))
        if least is None:
            # what a split has to gain: more than the rounding of sums of the target
            least = [1e-12 * max(1.0, float(h[0, :, 0].sum())) for h in root]
        growing = [Growing(h, s) for h, s in zip(root, best_splits(root, picked, categorical, o.min_rows))]
        while any(wanted := [t.wanted(o.leaves, e) for t, e in zip(growing, least)]):
            left = ask([(t.tree, [(k, t.open[k][1][1:]) for k in nodes]) for t, nodes in zip(growing, wanted)])
            owner = np.repeat(np.arange(len(models)), [len(nodes) for nodes in wanted])
            right = np.stack([growing[m].open[k][0] for m, nodes in enumerate(wanted) for k in nodes]) - left
            splits = [best_splits(h, picked[owner], categorical, o.min_rows) for h in (left, right)]
            for k, (m, node) in enumerate((m, node) for m, nodes in enumerate(wanted) for node in nodes):
                growing[m].ahead[node] = [(h[k], s[k]) for h, s in zip((left, right), splits)]
            for t, e in zip(growing, least):
                t.grow(o.leaves, e)
        for model, t in zip(models, growing):
            t.tree.value = [o.rate * v for v in t.tree.value]
            model.trees.append(t.tree)
            model.gain += t.gain
        after([t.tree for t in growing])


def unpacked(r, width: int, models: int = 0) -> tuple:
    """(codes, fold, rows, sum of the target, predictions saved for so many models) of a block's row."""
    base = np.frombuffer(r.base, np.float64).reshape(models, r.n) if models else None
    return np.frombuffer(r.x, np.uint8).reshape(r.n, width), np.frombuffer(r.fold, np.uint8).astype(np.int16), np.frombuffer(r.rows, np.float64), np.frombuffer(r.total, np.float64), base


def train(d: Design, models: Sequence[tuple[int | None, Sequence[str]]], iterations: int = ROUNDS, apart: bool | None = None, **options) -> list[Model]:
    """A model for each (fold left out or None, features).

    If all cells fit into one task (``TASK`` blocks; ``apart`` overrides this), each model grows in a task of its own, and
    tasks grow them in parallel; else a round is a few jobs over all cells for all models. Models are the same.
    """
    o, width = Options(iterations, **options), len(d.features)
    outs = [-1 if out is None else out for out, _ in models]
    use = np.array([[f in own for f in d.features] for _, own in models])
    sums = np.array([[sum(v[k] for fold, v in d.sums.items() if fold != out) for k in (0, 1)] for out in outs])
    starts = sums[:, 1] / np.maximum(sums[:, 0], 1)
    found = [Model(list(own), float(s), gain=np.zeros(width)) for (_, own), s in zip(models, starts)]
    categorical = d.categorical
    if d.tasks == 1 if apart is None else apart:

        def alone(k_blocks):
            k, rows = k_blocks
            x, fold, n, total = (np.concatenate(a) for a in list(zip(*[unpacked(r, width) for r in rows]))[:4])
            model, scores = found[k], np.full((1, len(x)), starts[k])

            def ask(asked):
                out = np.zeros((sum(len(nodes) for _, nodes in asked), width, BINS, 2))
                add_block(out, (0, x, fold, n, total, None), scores, outs[k : k + 1], asked)
                return out

            def after(trees):
                scores[0] += trees[0](x)

            boost([model], use[k : k + 1], categorical, o, ask, after)
            return k, model

        copies = d.blocks.rdd.flatMap(lambda r: [(k, r) for k in range(len(found))])
        return [m for _, m in sorted(copies.groupByKey(len(found), lambda k: k).map(alone).collect(), key=lambda r: r[0])]

    run = uuid.uuid4().hex
    numbered = lambda frame, base: frame.rdd.zipWithIndex().map(lambda rk: (rk[1], *unpacked(rk[0], width, base))).persist(StorageLevel.MEMORY_AND_DISK)
    state = {"blocks": numbered(d.blocks, 0), "saved": 0, "recent": []}

    def ask(asked):
        return histograms(state["blocks"], run, starts, outs, state["saved"], state["recent"], asked)

    def after(trees):
        state["recent"] = [*state["recent"], trees]
        if len(state["recent"]) == SAVE:
            frame = saved_predictions(d, run, state["blocks"], starts, state["saved"], state["recent"])
            state["blocks"].unpersist()
            state.update(blocks=numbered(frame, len(found)), saved=state["saved"] + SAVE, recent=[])

    boost(found, use, categorical, o, ask, after)
    state["blocks"].unpersist()
    return found


def saved_predictions(d: Design, run: str, blocks, starts: np.ndarray, saved: int, trees: list) -> DataFrame:
    """The blocks with what the trees so far predict: a written table."""

    def one(block):
        number, x, fold, rows, total, _ = block
        base = predictions(run, block, starts, saved, trees)
        return len(x), x.tobytes(), fold.astype(np.uint8).tobytes(), rows.tobytes(), total.tobytes(), base.tobytes()

    return frozen(d.rows.sparkSession.createDataFrame(blocks.map(one), f"{BLOCKS}, base binary", verifySchema=False))


# Results


def by_distinct_rows(x: np.ndarray, f) -> np.ndarray:
    """``f`` of every row of x, computed once for equal rows."""
    if not len(x):
        return f(x)
    own, at = np.unique(x, axis=0, return_inverse=True)
    return f(own)[at.ravel()]


def codes_of(batch, column: int, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().astype(np.uint8).reshape(-1, width)


def predict(d: Design, models: dict, counted: bool = False) -> DataFrame:
    """(y, fold, prediction) of the design's rows, each by the model of its fold (or the one under None); ``counted``: with n, of equal rows together."""
    width = len(d.features)

    def run(batches):
        for b in batches:
            x, fold = codes_of(b, 2, width), b.column(1).to_numpy()
            out = np.empty(len(x))
            for k in np.unique(fold):
                out[fold == k] = by_distinct_rows(x[fold == k], models.get(int(k), models.get(None)).predict)
            own = [b.column(3)] if counted else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out), *own], names=["y", "fold", "prediction", "n"][: 3 + counted])

    return (d.counted if counted else d.rows).mapInArrow(run, "y double, fold int, prediction double" + ", n double" * counted)


def metrics(d: Design, parts: DataFrame, n_features: int) -> dict:
    """Fit of the predictions ``parts`` of all rows, or of equal rows with their number n."""
    n, total = (sum(v[k] for v in d.sums.values()) for k in (0, 1))
    y, p, k, mean = F.col("y"), F.col("prediction"), F.col("n") if "n" in parts.columns else F.lit(1.0), total / n
    r = parts.agg(F.sum(k * (y - p) * (y - p)), F.sum(k * (y - mean) * (y - mean)), F.sum(k * F.abs(y - p)), F.sum(k * F.abs(y - mean))).first()
    return {"n": int(n), "n_features": n_features, "r2_oof": 1 - r[0] / r[1] if r[1] else float("nan"), "mae_oof": r[2] / n, "mae_baseline": r[3] / n}


def fold_models(d: Design) -> list[int | None]:
    """The folds to leave out, and None for the final model."""
    if len(d.sums) < 2:
        raise ValueError("out_of_fold: two groups at least are needed")
    return [*sorted(d.sums), None]


def out_of_fold(df: DataFrame, features: Sequence[str], target: str, group: str, iterations: int = ROUNDS, **options):
    """(metrics, out-of-fold predictions, final model on all rows, design). Every row is predicted by a model that never saw its group."""
    d = design(df, features, target, group)
    outs = fold_models(d)
    found = dict(zip(outs, train(d, [(o, d.features) for o in outs], iterations, **options)))
    final = found.pop(None)
    parts = predict(d, found)
    return metrics(d, predict(d, found, counted=True), len(d.features)), parts, final, d


def comparison(df: DataFrame, full: Sequence[str], demographic: Sequence[str], target: str, group: str, iterations: int = ROUNDS, **options) -> list[dict]:
    """The mean predictor, a demographic model and the full one; all folds of both grow side by side."""
    d = design(df, [*full, *[f for f in demographic if f not in full]], target, group)
    outs = fold_models(d)[:-1]
    sets = {"demographics only": list(demographic), "full model": list(full)}
    found = train(d, [(o, own) for own in sets.values() for o in outs], iterations, **options)
    rows = []
    for k, (name, own) in enumerate(sets.items()):
        m = metrics(d, predict(d, dict(zip(outs, found[k * len(outs) :])), counted=True), len(own))
        rows.append({"model": name, **{c: m[c] for c in ("n_features", "r2_oof", "mae_oof")}})
    return [{"model": "mean predictor", "n_features": 0, "r2_oof": 0.0, "mae_oof": m["mae_baseline"]}, *rows]


def tree_shapley(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, float]:
    """(Shapley values (rows, features), mean) of a tree.

    A coalition's value is what the tree predicts if features outside it follow each branch as often as the rows it
    was grown on. A leaf's part of a feature is a sum over the coalitions of the other features on its path; by
    size, these are the coefficients of a product of linear terms.
    """
    phi, mean = np.zeros(x.shape), 0.0
    for value, shares, codes in tree.paths():
        on = {f: codes[f][x[:, f]] for f in shares}
        mean += value * math.prod(shares.values())
        d = len(shares)
        weight = np.array([math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)])
        for f in shares:
            by_size = np.zeros((d, len(x)))
            by_size[0] = 1
            for g in shares:
                if g != f:
                    by_size[1:] = by_size[1:] * shares[g] + by_size[:-1] * on[g]
                    by_size[0] *= shares[g]
            phi[:, f] += value * (on[f] - shares[f]) * (weight @ by_size)
    return phi, mean


def shapley(model: Model, x: np.ndarray) -> tuple[np.ndarray, float]:
    """(Shapley values, mean prediction) of a boosted model: a row's values sum to its prediction less the mean."""
    phi, mean = np.zeros(x.shape), model.start
    for tree in model.trees:
        p, m = tree_shapley(tree, x)
        phi += p
        mean += m
    return phi, mean


def explain(d: Design, model: Model) -> DataFrame:
    """(y, prediction, shap) of the design's rows: an array of values by feature."""
    width = len(d.features)

    def run(batches):
        for b in batches:
            x = codes_of(b, 2, width)
            both = by_distinct_rows(x, lambda own: np.column_stack([model.predict(own), shapley(model, own)[0]]))
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * width + 1, width, dtype=np.int32)), pa.array(both[:, 1:].ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(both[:, 0]), values], names=["y", "prediction", "shap"])

    return d.rows.mapInArrow(run, "y double, prediction double, shap array<double>")


def importance(model: Model, d: Design) -> list[dict]:
    """Each feature's mean absolute and mean signed Shapley value over all rows, and its share of what splits gained; largest first.

    Equal rows are explained once, a block of cells at a time; the driver sees sums.
    """
    width = len(d.features)

    def sums(r):
        x, n = np.frombuffer(r.x, np.uint8).reshape(r.n, width), np.frombuffer(r.rows, np.float64)
        phi, _ = shapley(model, x)
        return np.stack([n @ np.abs(phi), n @ phi])

    size, signed = d.blocks.rdd.map(sums).treeReduce(lambda a, b: a + b) / sum(n for n, _ in d.sums.values())
    gain = model.gain / max(model.gain.sum(), 1e-300)
    out = [{"feature": f, "mean_abs_shap": float(size[k]), "mean_shap": float(signed[k]), "gain": float(gain[k])} for k, f in enumerate(d.features)]
    return sorted(out, key=lambda r: -r["mean_abs_shap"])
