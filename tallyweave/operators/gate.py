"""Validation gate: computed shares against published ones."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published shares (check, share) and how far off a computed one may be.
PUBLISHED = {
    "qc8_2_agree_eu27": 0.37,
    "qc8_5_agree_eu27": 0.65,
    "qc7_5_over_7d_eu27": 0.34,
    "qc7_4_over_7d_eu27": 0.29,
    "qc7_3_over_7d_eu27": 0.20,
    "qc8_2_agree_SI": 0.65,
    "qc8_2_agree_MT": 0.25,
}
TOLERANCE = 0.03


@dataclass(frozen=True)
class Check:
    name: str
    computed: Column
    published: float


def run_gate(df: DataFrame, checks: Sequence[Check], tolerance: float = TOLERANCE) -> DataFrame:
    """All checks in one aggregation. Figures are rounded for display; the verdict uses unrounded ones.

    A check that cannot be computed fails.
    """
    one = df.agg(*[c.computed.alias(f"c{i}") for i, c in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(c.name).alias("check"), F.lit(float(c.published)).alias("published"), F.col(f"c{i}").alias("v")) for i, c in enumerate(checks)])
    t = one.select(F.inline(rows))
    delta = F.col("v") - F.col("published")
    return t.select("check", "published", F.round("v", 4).alias("computed"), F.round(delta, 4).alias("delta"), F.coalesce(F.abs(delta) <= tolerance, F.lit(False)).alias("pass"))


def survey_checks() -> list[Check]:
    """The seven published figures over a cleaned survey."""
    from ..functions import estimators as E
    from .indices import over_a_week

    agree = lambda item, where=None, w="w_eu": E.weighted_mean(F.col(f"prep_{item}_agree_topline").cast("double"), w, where)
    country = lambda c: F.col("country_grouped") == c
    computed = {
        "qc8_2_agree_eu27": agree("feels_well_prepared"),
        "qc8_5_agree_eu27": agree("needs_more_info"),
        "qc7_5_over_7d_eu27": over_a_week("days_medication", "w_eu"),
        "qc7_4_over_7d_eu27": over_a_week("days_food", "w_eu"),
        "qc7_3_over_7d_eu27": over_a_week("days_gas_heating", "w_eu"),
        "qc8_2_agree_SI": agree("feels_well_prepared", country("SI"), "w_national"),
        "qc8_2_agree_MT": agree("feels_well_prepared", country("MT"), "w_national"),
    }
    return [Check(k, c, PUBLISHED[k]) for k, c in computed.items()]


def report(result: DataFrame | None) -> tuple[int, str]:
    """(exit code, text): 0 all pass, 1 some fail, 2 no input."""
    if result is None:
        return 2, "no input"
    rows = result.collect()
    lines = [f"{'PASS' if r['pass'] else 'FAIL'}  {r['check']}: published {r['published']:.3f}, computed {r['computed']}" for r in rows]
    return int(not all(r["pass"] for r in rows)), "\n".join(lines)
