"""Indices of a preparedness survey: resilience horizon, awareness-action gap, conversion.

Row-wise indices are projections. Tables over items unpivot the items and aggregate once, instead of
one scan per item and estimate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import estimators as E
from ..functions import expr as X

# Days at a band's middle, the target in days, and what the bands and cells mean.
MIDPOINT_DAYS = {1: 1.0, 2: 2.5, 3: 5.5, 4: 10.0}
TARGET_DAYS = 3.0
BAND_LABELS = {1: "1 day or less", 2: "2-3 days", 3: "4-7 days", 4: "More than 7 days"}
CELLS = {"converted": "aware and acted", "gap": "aware, not acted", "intrinsic": "acted without awareness", "unreached": "neither"}


def horizon_index(df: DataFrame, domains: Mapping[str, str], not_applicable: Mapping[str, str] | None = None, min_domains: int = 3) -> DataFrame:
    """The weakest domain decides. domains: name to band column; not_applicable: name to flag column.

    Adds rhi_n_domains, rhi_band, rhi_days, rhi_binding_domain (the first weakest), rhi_partial. Below
    ``min_domains`` answers all but the number are null. A domain that does not apply is no gap.
    """
    cols, names = list(domains.values()), list(domains)
    n = X.n_answered(cols)
    scored = n >= min_domains
    flags = [F.coalesce(F.col(c), F.lit(False)).cast("int") for c in (not_applicable or {}).values() if c in df.columns]
    band = F.when(scored, X.row_min(cols))
    return df.withColumns(
        {
            "rhi_n_domains": n,
            "rhi_band": band,
            "rhi_days": X.recode(band.cast("int"), MIDPOINT_DAYS),
            "rhi_binding_domain": F.when(scored, X.row_argmin(cols, names)),
            "rhi_partial": F.when(scored, n + sum(flags, F.lit(0)) < len(cols)),
        }
    )


def target_bounds(weight: str, where=None) -> dict[str, F.Column]:
    """Share certainly, and at most, below the target: the lowest band, and the one that contains it."""
    return {
        "below_target_certain": E.weighted_share(F.col("rhi_band") == 1, weight, where=where),
        "below_target_upper": E.weighted_share(F.col("rhi_band") <= 2, weight, where=where),
    }


def horizon_by_country(df: DataFrame, weight: str, country: str = "country_grouped") -> DataFrame:
    t = df.where(F.col(country).isNotNull() & F.col("rhi_band").isNotNull()).groupBy(country)
    t = t.agg(E.weighted_mean("rhi_days", weight).alias("mean_days"), *[c.alias(n) for n, c in target_bounds(weight).items()], F.count("*").alias("n_rows"), E.effective_n(weight).alias("n_eff"))
    return t.withColumnRenamed(country, "country").orderBy(F.desc("below_target_certain"), "country")


def band_distribution(df: DataFrame, weight: str, band: str = "rhi_band") -> DataFrame:
    """Weighted share of each band; bands without rows have share 0 (null if no row counts)."""
    shares = [E.weighted_share(F.col(band) == b, weight).alias(f"s{b}") for b in BAND_LABELS]
    rows = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(text).alias("label"), F.col(f"s{b}").alias("share")) for b, text in BAND_LABELS.items()])
    return df.agg(*shares).select(F.inline(rows))


def binding_profile(df: DataFrame, domains: Mapping[str, str], weight: str) -> DataFrame:
    """Per domain: how often it binds, its median band (unweighted), and the share at a day or less."""
    rows = F.array(*[F.struct(F.lit(n).alias("domain"), F.col(c).alias("band")) for n, c in domains.items()])
    t = df.select(F.col(weight).alias("w"), F.col("rhi_binding_domain").alias("binding"), F.explode(rows).alias("d")).select("w", "binding", "d.*")
    return (
        t.groupBy("domain")
        .agg(
            E.weighted_share(F.col("binding") == F.col("domain"), "w").alias("share_binding"),
            F.median("band").alias("median_band"),
            E.weighted_share(F.col("band") == 1, "w").alias("pct_one_day_or_less"),
        )
        .orderBy(F.desc("share_binding"), "domain")
    )


def over_a_week(domain: str, weight: str, dont_know_counts: bool = True) -> F.Column:
    """Share with more than seven days; missing answers stay in the denominator unless told otherwise."""
    return E.weighted_share(F.col(domain) == 4, weight, missing_as_no=dont_know_counts)


def _item_rows(df: DataFrame, items: Mapping[str, str], weight: str, aware: str, *keep: str) -> DataFrame:
    """Long form: (kept columns, w, aware, item, act)."""
    rows = F.array(*[F.struct(F.lit(n).alias("item"), F.col(c).cast("double").alias("act")) for n, c in items.items()])
    return df.select(*keep, F.col(weight).alias("w"), F.col(aware).alias("aware"), F.explode(rows).alias("i")).select(*keep, "w", "aware", "i.*")


def gap_table(df: DataFrame, items: Mapping[str, str], weight: str, aware: str, by: Sequence[str] = ()) -> DataFrame:
    """Per item (and ``by``): shares who acted, overall and by awareness, gap, lift, interval of the conversion.

    The interval rests on the effective number of aware rows that answered. Null awareness is in neither group.
    """
    t = _item_rows(df, items, weight, aware, *by)
    yes, no = F.col("aware"), ~F.col("aware")
    answered = F.col("act").isNotNull()
    out = t.groupBy(*by, "item").agg(
        E.weighted_mean("act", "w").alias("pct_did_overall"),
        E.weighted_mean("act", "w", yes).alias("pct_did_if_aware"),
        E.weighted_mean("act", "w", no).alias("pct_did_if_not_aware"),
        E.effective_n("w", yes & answered).alias("n_eff"),
        F.count_if(yes & answered).alias("n_aware_rows"),
        F.count_if(no & answered).alias("n_unaware_rows"),
    )
    p = F.col("pct_did_if_aware")
    return out.withColumns(
        {"conversion": p, "gap": 1.0 - p, "lift": F.try_divide(p, F.nullif(F.col("pct_did_if_not_aware"), F.lit(0.0))), "ci_low": E.wald_low(p, "n_eff"), "ci_high": E.wald_high(p, "n_eff")}
    ).orderBy(F.desc("conversion"), "item")


def gap_cells(df: DataFrame, items: Mapping[str, str], weight: str, aware: str) -> DataFrame:
    """Weighted share of person-item pairs in the four cells of awareness and action, in fixed order."""
    t = _item_rows(df, items, weight, aware).where(E.usable("w", "act") & F.col("aware").isNotNull())
    did = F.col("act") == 1
    held = {"converted": F.col("aware") & did, "gap": F.col("aware") & ~did, "intrinsic": ~F.col("aware") & did, "unreached": ~F.col("aware") & ~did}
    sums = t.agg(*[F.sum(F.when(c, F.col("w")).otherwise(0.0)).alias(n) for n, c in held.items()], F.sum("w").alias("total"))
    rows = F.array(*[F.struct(F.lit(n).alias("cell"), F.lit(CELLS[n]).alias("meaning"), F.try_divide(F.col(n), F.col("total")).alias("weighted_share")) for n in held])
    return sums.select(F.inline(rows))


def person_gap(items: Sequence[str], aware: str, item_weights: Mapping[str, float] | None = None) -> F.Column:
    """Share (by item weight) of answered items not done, for the aware; null for others and without answers."""
    w = {c: float((item_weights or {}).get(c, 1.0)) for c in items}
    answered = sum((F.when(F.col(c).isNotNull(), w[c]).otherwise(0.0) for c in items), F.lit(0.0))
    missed = sum((F.when(F.col(c) == 0, w[c]).otherwise(0.0) for c in items), F.lit(0.0))
    return F.when(F.coalesce(F.col(aware), F.lit(False)) & (answered > 0), missed / F.nullif(answered, F.lit(0.0)))


def composite(scores: DataFrame, weights: tuple[float, float, float], by: str) -> DataFrame:
    """Ranking by a weighted composite of pri, horizon band and inverted gap; weights are scaled to sum 1.

    Rows lacking one of the three are left out. A weight sum of zero is an error.
    """
    total = sum(weights)
    if total <= 0:
        raise ValueError("composite: the weights sum to zero")
    a, b, c = (x / total for x in weights)
    t = scores.where(F.col("pri").isNotNull() & F.col("rhi_band").isNotNull() & F.col("pgi").isNotNull())
    score = a * F.col("pri") + b * (F.col("rhi_band") - 1) / 3 * 100 + c * (1 - F.col("pgi")) * 100
    return t.withColumn("score", score).groupBy(by).agg(E.weighted_mean("score", "w").alias("composite"), F.count("*").alias("n")).orderBy(F.desc("composite"), by)
