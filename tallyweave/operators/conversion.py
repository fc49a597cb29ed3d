"""Awareness-conversion index from paired columns, with column and weight discovery, stages and crosswalk.

Yearly files differ in headers and codings: columns are found by prefix and keyword, and yes/no codings
are decided per year and column before anything is stacked.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import estimators as E

# Items with labels and the words that identify their columns, prefixes, weight names, stages.
ITEM_LABELS = {
    "alerts": "Sign up for alerts and warnings",
    "make_plan": "Make a plan",
    "rainy_day": "Save for a rainy day",
    "drills": "Practice emergency drills or habits",
    "family_comms": "Test family communication plan",
    "documents": "Safeguard documents",
    "neighbours": "Plan with neighbours",
    "supplies": "Assemble or update supplies",
    "community": "Get involved in your community",
    "home_safer": "Make your home safer",
    "evacuation_routes": "Know evacuation routes",
    "insure_property": "Document and insure property",
}
ITEM_KEYWORDS = {
    "alerts": ("alert", "warning"),
    "make_plan": ("plan",),
    "rainy_day": ("rainy", "saving", "save"),
    "drills": ("drill", "practice", "habit"),
    "family_comms": ("communication", "comms"),
    "documents": ("document", "safeguard"),
    "neighbours": ("neighbor", "neighbour"),
    "supplies": ("supply", "supplies"),
    "community": ("community", "involve"),
    "home_safer": ("home", "safer"),
    "evacuation_routes": ("evacuat", "route"),
    "insure_property": ("insur", "property"),
}
AWARENESS_PREFIX, ACTION_PREFIX = "A3", "PREPB"
WEIGHT_NAMES = ("weight", "WEIGHT", "wgt", "WGT", "finalwt", "FINALWT", "nhs_weight")
STAGES = {
    1: "Not prepared, no intention",
    2: "Not prepared, intends within a year",
    3: "Not prepared, intends within six months",
    4: "Prepared for less than a year",
    5: "Prepared over a year, still preparing",
}
YES, NO = ("yes", "y", "true", "1"), ("no", "n", "false", "0", "2")


def _column(columns: Sequence[str], prefix: str, words: Sequence[str]) -> str | None:
    start = re.compile(rf"^{re.escape(prefix)}|_{re.escape(prefix)}", re.IGNORECASE)
    word = re.compile("|".join(map(re.escape, words)), re.IGNORECASE)
    return next((c for c in columns if start.search(c) and word.search(c)), None)


def discover_columns(columns: Sequence[str]) -> list[dict]:
    """A row per item: its awareness and action column (the first by header order, or None), whether both
    are there, and whether another item claims one of them, too."""
    rows = [
        {"item": i, "label": ITEM_LABELS[i], "awareness_col": _column(columns, AWARENESS_PREFIX, words), "action_col": _column(columns, ACTION_PREFIX, words)}
        for i, words in ITEM_KEYWORDS.items()
    ]
    taken = [r[k] for r in rows for k in ("awareness_col", "action_col") if r[k]]
    for r in rows:
        r["paired"] = bool(r["awareness_col"] and r["action_col"])
        r["claimed_twice"] = any(taken.count(r[k]) > 1 for k in ("awareness_col", "action_col") if r[k])
    return rows


def find_weight(columns: Sequence[str]) -> str | None:
    """The first known weight name that is there, else the first header with ``weight`` or that ends in ``wt``."""
    known = [c for c in WEIGHT_NAMES if c in columns]
    return known[0] if known else next((c for c in columns if re.search(r"weight|wt$", c, re.IGNORECASE)), None)


def pairing_gate(rows: Sequence[dict]) -> tuple[int, str]:
    """(exit code, message): no pair is a failure, fewer than half a warning."""
    n = sum(r["paired"] for r in rows)
    if not n:
        return 1, "no item has both an awareness and an action column"
    return 0, f"warning: only {n} of {len(rows)} items are paired" if 2 * n < len(rows) else f"{n} of {len(rows)} items are paired"


def yes_no(df: DataFrame, cols: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """``cols`` as 1 (yes), 0 (no) or null, by each column's own coding (within each group of ``within``).

    Text reads as yes or no by its word. Numbers are coded 1/2 if a 2 and no 0 occurs, other codes aside
    (a refusal code decides nothing); else 0/1. One aggregation covers all columns.
    """
    text = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    num = lambda c: text(c).try_cast("double")
    is_word = lambda c: text(c).isin("yes", "y", "true", "no", "n", "false")
    stats = []
    for c in cols:
        stats += [F.bool_or(is_word(c)).alias(f"_w_{c}"), F.bool_or(num(c) == 2).alias(f"_2_{c}"), F.bool_or(num(c) == 0).alias(f"_0_{c}")]
    if within:
        found = df.groupBy(*within).agg(*stats)
        keys = [F.col(f"_g_{g}").eqNullSafe(F.col(g)) for g in within]
        found = found.select(*[F.col(g).alias(f"_g_{g}") for g in within], *[c for c in found.columns if c not in within])
        on = keys[0]
        for k in keys[1:]:
            on &= k
        j = df.join(found, on)
    else:
        one = df.agg(*stats).withColumn("_one", F.lit(1))
        j = df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one")
    new = {}
    for c in cols:
        word = F.when(text(c).isin(*YES), 1.0).when(text(c).isin(*NO), 0.0)
        one_two = F.when(num(c) == 1, 1.0).when(num(c) == 2, 0.0)
        zero_one = F.when(num(c) == 1, 1.0).when(num(c) == 0, 0.0)
        new[c] = F.when(F.coalesce(F.col(f"_w_{c}"), F.lit(False)), word).when(F.coalesce(F.col(f"_2_{c}"), F.lit(False)) & ~F.coalesce(F.col(f"_0_{c}"), F.lit(False)), one_two).otherwise(zero_one)
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def aci_table(df: DataFrame, pairs: Mapping[str, tuple[str, str]], weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Per item (and ``by``): conversion of awareness into action, gap, lift, shares, interval.

    pairs: item to (awareness, action) columns, already 0/1. Without a weight column every row weighs 1
    and ``weighted`` is false. The interval rests on the effective number of aware rows.
    """
    weighted = weight is not None and weight in df.columns
    w = F.col(weight).cast("double") if weighted else F.lit(1.0)
    rows = F.array(*[F.struct(F.lit(i).alias("item"), F.col(a).alias("aware"), F.col(b).alias("act")) for i, (a, b) in pairs.items()])
    t = df.select(*by, w.alias("w"), F.explode(rows).alias("r")).select(*by, "w", "r.*").where(E.usable("w", "aware") & F.col("act").isNotNull())
    aware, not_aware = F.col("aware") == 1, F.col("aware") == 0
    t = t.groupBy(*by, "item").agg(
        E.weighted_mean("act", "w", aware).alias("aci"),
        E.weighted_mean("act", "w", not_aware).alias("p_did_if_unaware"),
        E.weighted_mean("aware", "w").alias("share_aware"),
        F.count("*").alias("n_rows"),
        E.effective_n("w", aware).alias("n_eff"),
    )
    labels = F.create_map(*[F.lit(x) for i in pairs for x in (i, ITEM_LABELS.get(i, i))])
    p = F.col("aci")
    return t.withColumns(
        {
            "label": labels[F.col("item")],
            "gap": 1.0 - p,
            "lift": F.try_divide(p, F.nullif(F.col("p_did_if_unaware"), F.lit(0.0))),
            "ci_low": E.wald_low(p, "n_eff"),
            "ci_high": E.wald_high(p, "n_eff"),
            "weighted": F.lit(weighted),
        }
    ).orderBy(*by, F.desc("aci"), "item")


def stage_distribution(df: DataFrame, stage: str, weight: str | None = None) -> DataFrame:
    """Weighted share of each stage of change, stages without rows included."""
    w = F.col(weight).cast("double") if weight and weight in df.columns else F.lit(1.0)
    t = df.select(F.col(stage).try_cast("double").alias("s"), w.alias("w")).where(F.col("s").isin(*STAGES))
    aggs = [E.weighted_share(F.col("s") == k, "w").alias(f"s{k}") for k in STAGES] + [F.count_if((F.col("s") == k) & E.usable("w")).alias(f"n{k}") for k in STAGES]
    rows = F.array(*[F.struct(F.lit(k).alias("stage"), F.lit(v).alias("label"), F.coalesce(F.col(f"s{k}"), F.lit(0.0)).alias("share"), F.col(f"n{k}").alias("n_rows")) for k, v in STAGES.items()])
    return t.agg(*aggs).select(F.inline(rows))


def crosswalk_compare(crosswalk: DataFrame, aci: DataFrame, gap: DataFrame) -> DataFrame:
    """Crosswalk rows whose items are in both tables, with both lifts and the pair's own note (null if it has none).

    One survey asks about a recent flow, the other about a stock: ``recall_windows_differ`` says so in every
    row; directions compare, levels do not pool.
    """
    c = crosswalk.where(F.col("home_item").isNotNull() & F.col("other_item").isNotNull())
    a = aci.select(F.col("item").alias("other_item"), "aci", F.col("lift").alias("lift_other"))
    g = gap.select(F.col("item").alias("home_item"), "conversion", F.col("lift").alias("lift_home"))
    j = c.join(a, "other_item").join(g, "home_item")
    note = F.col("note") if "note" in crosswalk.columns else F.lit(None).cast("string")
    return j.select("home_item", "other_item", "match_quality", "aci", "conversion", (100.0 * (F.col("aci") - F.col("conversion"))).alias("conversion_gap_pp"), "lift_other", "lift_home", note.alias("note"), F.lit(True).alias("recall_windows_differ")).orderBy("home_item", "other_item")
