"""Weighted quantiles by interpolation between midpoints of cumulative weight.

Rows are ordered by (value, weight); a row's position is (weight before it + half its own) / total.
Between positions values are interpolated, beyond the first and last they are constant.

No window covers a group. Equal (value, weight) rows are one block; blocks are written once in ranges of
(group, value, weight), and the ranges' weights are added up in order, a row per range. A quantile lies between
two ranges, where the ends of both give it, or inside one: only the blocks of such a range are ranked, on top of
the weight before it. Nothing depends on where ranges end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import estimators as E
from .frozen import in_order

def blocks(df: DataFrame, value: str, weight: str, group: str | None = None) -> DataFrame:
    """(g, v, w, k): the usable rows, equal ones counted; null groups included."""
    g = F.col(group) if group else F.lit("all")
    t = df.where(E.usable(weight, value)).select(g.alias("g"), F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w"))
    return t.groupBy("g", "v", "w").agg(F.count("*").cast("double").alias("k"))


def weighted_quantiles(df: DataFrame, value: str, weight: str, qs: Sequence[float], group: str | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """One row per group with usable rows (null groups left out): the group and a column per quantile."""
    names = names or [f"p{round(q * 100)}" for q in qs]
    t = in_order(blocks(df, value, weight, group).where("g IS NOT NULL"), "g", "v", "w")
    out = block_quantiles(t, qs, names)
    return out.withColumnRenamed("g", group) if group else out.drop("g")


def block_quantiles(t: DataFrame, qs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """(g, a column per quantile) of ``blocks`` without null groups that ``in_order`` has cut by (g, v, w)."""
    weight = F.col("w") * F.col("k")
    # numbers first, which are hashed: structs, for which rows are sorted, are made of the ends' rows alone
    parts = t.groupBy("g", "part").agg(F.sum(weight).alias("held"), F.min("v").alias("v_first"), F.max("v").alias("v_last"))
    ends = t.join(F.broadcast(parts.select("g", "part", "v_first", "v_last")), ["g", "part"]).where("v IN (v_first, v_last)")
    ends = ends.groupBy("g", "part").agg(F.min(F.struct("v", "w")).alias("first"), F.max(F.struct("v", "w")).alias("last"))
    parts = parts.select("g", "part", "held").join(ends, ["g", "part"])
    # windows of a group's ranges: as many rows as there are partitions, at most
    group = Window.partitionBy("g")
    over = group.orderBy("part")
    before = F.coalesce(F.sum("held").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    parts = parts.select("*", before.alias("before"), F.sum("held").over(group).alias("total"), F.lead("first").over(over).alias("nxt"), F.lag("part").over(over).isNull().alias("is_first"))
    at = lambda weight: weight / F.col("total")
    parts = parts.select(
        "*",
        at(F.col("before") + 0.5 * F.col("first.w")).alias("low"),
        at(F.col("before") + F.col("held") - 0.5 * F.col("last.w")).alias("high"),
        at(F.col("before") + F.col("held") + 0.5 * F.col("nxt.w")).alias("low_next"),
    )

    def between(q: float, v: str, f: str, v_next: str, f_next: str) -> F.Column:
        return F.col(v) + (q - F.col(f)) / (F.col(f_next) - F.col(f)) * (F.col(v_next) - F.col(v))

    def outside(q: float) -> F.Column:
        """The quantile, if it lies before the first range, behind this one's last block and before the next one's first, or behind the last range."""
        begin = F.when(F.col("is_first") & (F.lit(q) < F.col("low")), F.col("first.v"))
        gap = F.when(F.col("high") < q, F.when(F.col("nxt").isNull(), F.col("last.v")).when(F.col("low_next") > q, between(q, "last.v", "high", "nxt.v", "low_next")))
        return F.coalesce(begin, gap)

    inside = F.exists(F.array(*[F.lit(float(q)) for q in qs]), lambda q: (F.col("low") <= q) & (q <= F.col("high")))
    rows = t.join(parts.where(inside).select("g", "part", "before", "total"), ["g", "part"])
    part = Window.partitionBy("g", "part").orderBy("v", "w")
    ahead = F.coalesce(F.sum(weight).over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.select("*", (F.col("before") + ahead).alias("c"), F.lead(F.struct("v", "w")).over(part).alias("nxt"))
    rows = rows.select(
        "g",
        "v",
        at(F.col("c") + 0.5 * F.col("w")).alias("f1"),
        at(F.col("c") + (F.col("k") - 0.5) * F.col("w")).alias("f2"),
        F.col("nxt.v").alias("v3"),
        at(F.col("c") + weight + 0.5 * F.col("nxt.w")).alias("f3"),
    )

    def within(q: float) -> F.Column:
        # a range's last block holds up to the range's end, however its sum was rounded
        holds = (F.col("f1") <= q) & ((F.lit(q) <= F.col("f2")) | F.col("f3").isNull())
        return F.when(holds, F.col("v")).when((F.col("f2") < q) & (F.lit(q) < F.col("f3")), between(q, "v", "f2", "v3", "f3"))

    found = parts.select("g", *[outside(q).alias(n) for q, n in zip(qs, names)]).unionByName(rows.select("g", *[within(q).alias(n) for q, n in zip(qs, names)]))
    return found.groupBy("g").agg(*[F.max(F.col(f"`{n}`")).alias(n) for n in names])


def percentile_table(df: DataFrame, value: str, group: str, weight: str, qs: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9), min_rows: int = 100) -> DataFrame:
    """Rows ``all`` and each group (as string): n_rows, n_eff, thin_cell and quantiles, two decimals."""
    t = df.select(F.col(value).alias("value"), F.col(weight).alias("weight"), F.col(group).cast("string").alias("label"))
    own = blocks(t, "value", "weight", "label")
    # the whole is made of the blocks, not of the rows again; null groups count in it alone
    every = own.groupBy("v", "w").agg(F.sum("k").alias("k")).select(F.lit("all").alias("g"), "v", "w", "k")
    t = in_order(every.unionByName(own.where("g IS NOT NULL")), "g", "v", "w")
    names = [f"p{round(q * 100)}" for q in qs]
    w, k = F.col("w"), F.col("k")
    n_eff = F.try_divide(F.sum(w * k) * F.sum(w * k), F.sum(w * w * k))
    size = t.groupBy("g").agg(F.sum("k").cast("long").alias("n_rows"), F.round(n_eff, 1).alias("n_eff"))
    q = block_quantiles(t, qs, names)
    return size.join(q, "g").select(F.col("g").alias("group"), "n_rows", "n_eff", (F.col("n_rows") < min_rows).alias("thin_cell"), *[F.round(n, 2).alias(n) for n in names])


def benchmark(value: float, reference: DataFrame, value_col: str, weight: str, label: str = "the reference group") -> dict:
    """A value's percentile in ``reference``, one decimal, and a sentence; None without usable rows."""
    p = reference.agg(E.percentile_of(value, value_col, weight).alias("p")).first()["p"]
    if p is None:
        return {"percentile": None, "sentence": f"No comparison is available for {label}."}
    p = round(p, 1)
    return {"percentile": p, "sentence": f"Higher than {p:.0f}% of {label}."}
