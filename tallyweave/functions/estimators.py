"""Weighted estimators as aggregate Columns.

They return Columns, not numbers, so one scan serves any number of estimates, for totals, groups and
items alike, with partial sums before the shuffle. A row counts if its weight is not null and
positive and its value is not null; an estimate without such rows is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import Col, _c

Z95 = 1.96


def usable(weight: Col, value: Col | None = None) -> Column:
    ok = _c(weight).isNotNull() & (_c(weight) > 0)
    return ok if value is None else ok & _c(value).isNotNull()


def weight_sum(weight: Col, where: Column | None = None) -> Column:
    ok = usable(weight) if where is None else usable(weight) & where
    return F.sum(F.when(ok, _c(weight).cast("double")))


def weighted_mean(value: Col, weight: Col, where: Column | None = None) -> Column:
    ok = usable(weight, value) if where is None else usable(weight, value) & where
    w = _c(weight).cast("double")
    return F.try_divide(F.sum(F.when(ok, _c(value).cast("double") * w)), F.sum(F.when(ok, w)))


def weighted_share(flag: Col, weight: Col, missing_as_no: bool = False, where: Column | None = None) -> Column:
    """Share of a 0/1 or boolean flag; missing flags are left out, or count as no."""
    f = _c(flag).cast("double")
    return weighted_mean(F.coalesce(f, F.lit(0.0)) if missing_as_no else f, weight, where)


def effective_n(weight: Col, where: Column | None = None) -> Column:
    """Kish's effective sample size; 0 without usable rows."""
    ok = usable(weight) if where is None else usable(weight) & where
    w = F.when(ok, _c(weight).cast("double"))
    return F.coalesce(F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w)), F.lit(0.0))


def n_usable(weight: Col, value: Col | None = None, where: Column | None = None) -> Column:
    ok = usable(weight, value)
    return F.count_if(ok if where is None else ok & where)


def wald_low(share: Col, n_eff: Col, z: float = Z95) -> Column:
    return _wald(share, n_eff, -z)


def wald_high(share: Col, n_eff: Col, z: float = Z95) -> Column:
    return _wald(share, n_eff, z)


def _wald(share: Col, n_eff: Col, z: float) -> Column:
    p, n = _c(share), _c(n_eff)
    half = z * F.sqrt(p * (1.0 - p) / F.when(n > 0, n))
    return F.when((n > 0) & p.isNotNull() & ~F.isnan(p), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p + half)))


def percentile_of(x: float | Column, value: Col, weight: Col) -> Column:
    """Weighted share below x plus half the share at x, in percent."""
    x = F.lit(float(x)) if not isinstance(x, Column) else x
    v, w, ok = _c(value), _c(weight).cast("double"), usable(weight, value)
    below = F.sum(F.when(ok & (v < x), w).when(ok & (v == x), 0.5 * w).when(ok, 0.0))
    return 100.0 * F.try_divide(below, F.sum(F.when(ok, w)))
