"""Weighted tables: shares by group, rankings, audits, frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import estimators as E
from .frozen import frozen, in_order


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of the one-row frame ``one``."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")


def share_by_group(df: DataFrame, flag: str, group: str, weight: str, missing_as_no: bool = False, min_n: int = 30) -> DataFrame:
    """Share with its interval per group, small cells flagged; null groups left out; largest share first."""
    f = F.coalesce(F.col(flag).cast("double"), F.lit(0.0)) if missing_as_no else F.col(flag).cast("double")
    ok = f.isNotNull()
    t = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        E.weighted_mean(f, weight).alias("share"),
        E.n_usable(weight, f).alias("n_rows"),
        E.effective_n(weight, ok).alias("n_eff"),
    )
    t = t.withColumn("ci_low", E.wald_low("share", "n_eff")).withColumn("ci_high", E.wald_high("share", "n_eff"))
    return t.withColumn("small_cell", F.col("n_rows") < min_n).orderBy(F.desc("share"), group)


def mean_by_level(df: DataFrame, level: str, value: str) -> DataFrame:
    """Unweighted mean and number of rows of each level."""
    return df.where(F.col(level).isNotNull() & F.col(value).isNotNull()).groupBy(level).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def level_spread(df: DataFrame, levels: Sequence[str], value: str) -> DataFrame:
    """For each level column: mean at its highest level less mean at its lowest. One scan, long form."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("level")) for c in levels])
    t = df.where(F.col(value).isNotNull()).select(F.explode(pairs).alias("p"), F.col(value).alias("v")).select("p.*", "v").where("level IS NOT NULL")
    m = t.groupBy("feature", "level").agg(F.avg("v").alias("mean"))
    return m.groupBy("feature").agg((F.max_by("mean", "level") - F.min_by("mean", "level")).alias("spread"))


def variance_audit(df: DataFrame, cols: Sequence[str], min_unique: int = 2, min_std: float = 0.01) -> DataFrame:
    """Distinct values, spread and missing share of each column, and whether to drop it; drops first, then flat ones."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])
    t = df.select(F.explode(pairs).alias("p")).select("p.*")
    # values first, so that distinct counting is a plain two-level aggregation
    t = t.groupBy("column", "v").agg(F.count("*").alias("n"))
    n, v = F.col("n"), F.col("v")
    total = F.sum(F.when(v.isNotNull(), n))
    # one row per audited column
    means = t.groupBy("column").agg(F.try_divide(F.sum(v * n), total).alias("mean"))
    t = t.join(F.broadcast(means), "column").withColumn("dev", n * (v - F.col("mean")) * (v - F.col("mean")))
    out = t.groupBy("column").agg(
        F.count("v").alias("n_unique"),
        F.round(F.sqrt(F.try_divide(F.sum("dev"), F.nullif(total - 1, F.lit(0)))), 6).alias("std"),
        F.round(100.0 * F.sum(F.when(v.isNull(), n).otherwise(0)) / F.sum(n), 2).alias("null_pct"),
    )
    out = out.withColumn("drop", (F.col("n_unique") < min_unique) | F.coalesce(F.col("std") < min_std, F.lit(True)))
    return out.orderBy(F.desc("drop"), "std", "column")


def frequencies(df: DataFrame, columns: Sequence[str], labels: dict[str, dict] | None = None) -> DataFrame:
    """(column, value, label, n, pct) of all ``columns`` in one scan: each value (missing included), percent with one decimal.

    Values are counted by column first, so that no column and no value is ever in one place as rows.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    t = df.select(F.explode(pairs).alias("p")).groupBy("p.column", F.coalesce("p.value", F.lit("missing")).alias("value")).agg(F.count("*").alias("n"))
    t = with_row(t, df.agg(F.count("*").alias("total")))
    known = [F.lit(str(x)) for c, own in (labels or {}).items() for k, v in own.items() for x in (f"{c}\0{k}", v)]
    label = F.try_element_at(F.create_map(*known), F.concat_ws("\0", "column", "value")) if known else F.lit(None).cast("string")
    return t.select("column", "value", F.coalesce(label, F.col("value")).alias("label"), "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))


def frequency_table(df: DataFrame, col: str, labels: dict | None = None) -> DataFrame:
    """``frequencies`` of one column."""
    return frequencies(df, [col], {col: labels or {}}).drop("column")


def first_per_group(df: DataFrame, group: Sequence[str] | str, order: Sequence[str]) -> DataFrame:
    """The first row of each group by ``order`` (which should be unique), by a partial minimum rather than a window."""
    group = [group] if isinstance(group, str) else list(group)
    rest = [c for c in df.columns if c not in group and c not in order]
    row = F.struct(*order, *rest)
    return df.groupBy(*group).agg(F.min(row).alias("r")).select(*group, "r.*")


def mean_ranks(counts: DataFrame, group: str | None = None) -> DataFrame:
    """(group, v, rank) of ``counts`` (group, v, n), distinct values and how often they occur: ties take their mean rank.

    Ranks are sums within ranges of values on top of the sums of earlier ranges (a row per group and range).
    """
    by = [group] if group else []
    t = in_order(counts, *by, "v")
    over = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = t.groupBy(*by, "part").agg(F.sum("n").alias("held")).select(*by, "part", F.coalesce(F.sum("held").over(over), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*by, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    t = t.join(parts, [*by, "part"])
    return t.select(*by, "v", (F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation (ties take their mean rank), Pearson's, and the number of rows with both values.

    Rows are counted by pair of values first. A value that most pairs share is one row of the ranks, so adaptive
    execution can split its side of the join.
    """
    t = df.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    pairs = frozen(t.groupBy("a", "b").agg(F.count("*").alias("n")))
    for c in "ab":
        ranks = mean_ranks(pairs.groupBy(F.col(c).alias("v")).agg(F.sum("n").alias("n")))
        pairs = pairs.join(ranks.select(F.col("v").alias(c), F.col("rank").alias(f"rank_{c}")), c)
    # means first, so that squares are of differences
    mean = lambda c: F.sum(F.col("n") * c) / F.sum("n")
    x = {"rank_a": F.col("rank_a"), "rank_b": F.col("rank_b"), "a": F.col("a").cast("double"), "b": F.col("b").cast("double")}
    pairs = with_row(pairs, pairs.agg(*[mean(v).alias(f"mean_{c}") for c, v in x.items()]))

    def correlation(c: str, d: str) -> F.Column:
        dev = {k: x[k] - F.col(f"mean_{k}") for k in (c, d)}
        return F.sum(F.col("n") * dev[c] * dev[d]) / F.nullif(F.sqrt(F.sum(F.col("n") * dev[c] * dev[c]) * F.sum(F.col("n") * dev[d] * dev[d])), F.lit(0.0))

    return pairs.agg(correlation("rank_a", "rank_b").alias("spearman"), correlation("a", "b").alias("pearson"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def mean_absolute_difference(a: str, b: str) -> F.Column:
    return F.avg(F.abs(F.col(a) - F.col(b)))


def top_k(df: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(k)


def ranked(df: DataFrame, by: str, tie: str) -> DataFrame:
    """A small result table with its display rank."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), tie)))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows, the same for a seed whatever the partitioning."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def stack_scopes(tables: dict[str, DataFrame], name: str = "scope") -> DataFrame:
    """Tables under one another, tagged; missing columns are null."""
    out = None
    for tag, df in tables.items():
        df = df.withColumn(name, F.lit(tag))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
