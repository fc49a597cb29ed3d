"""Scalars with explicit missing-value rules. Each returns a Column and adds no shuffle.

NaN and null are one missing value here: ``number`` turns NaN into null at the door, so that every
later comparison is three-valued.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def _c(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Col) -> Column:
    """As double; null for what is no number, and for NaN."""
    d = _c(c).try_cast("double")
    return F.when(~F.isnan(d), d)


def off_scale(c: Col, codes: Sequence[int] = (5, 6)) -> Column:
    """The value as double, null if it is an off-scale code."""
    return F.when(~_c(c).isin(*codes), _c(c).cast("double"))


def has_code(c: Col, code: int) -> Column:
    """Never null: is the value this code?"""
    return F.coalesce(_c(c) == code, F.lit(False))


def reversed_scale(c: Col, top: int = 4, codes: Sequence[int] = (5, 6)) -> Column:
    """An agreement scale turned round (top + 1 - value), off-scale codes null."""
    return F.lit(top + 1.0) - off_scale(c, codes)


def agrees(c: Col, least: float = 3) -> Column:
    """Three-valued: null where the answer is missing."""
    return _c(c) >= least


def agrees_topline(c: Col, least: float = 3) -> Column:
    """0 or 1, missing answers counting as 0."""
    return F.coalesce(_c(c) >= least, F.lit(False)).cast("byte")


def null_if(c: Col, condition: Column) -> Column:
    """The value, null where the condition holds (a null condition does not)."""
    return F.when(F.coalesce(condition, F.lit(False)), None).otherwise(_c(c))


def n_answered(cols: Sequence[Col]) -> Column:
    return reduce(lambda a, b: a + b, [_c(c).isNotNull().cast("int") for c in cols])


def row_sum(cols: Sequence[Col], least: int = 1) -> Column:
    """Sum of what is not null; null with fewer than ``least`` values."""
    total = reduce(lambda a, b: a + b, [F.coalesce(_c(c).cast("double"), F.lit(0.0)) for c in cols])
    return F.when(n_answered(cols) >= least, total)


def row_min(cols: Sequence[Col]) -> Column:
    return F.least(*[_c(c) for c in cols]) if len(cols) > 1 else _c(cols[0])


def row_argmin(cols: Sequence[str], names: Sequence[str] | None = None) -> Column:
    """The name of the first smallest column; null if all are null."""
    low = row_min(cols)
    out = F.when(_c(cols[0]) == low, F.lit((names or cols)[0]))
    for c, name in zip(cols[1:], (names or cols)[1:]):
        out = out.when(_c(c) == low, F.lit(name))
    return out


def clip_upper(c: Col, top: float) -> Column:
    return F.when(_c(c) > top, F.lit(float(top))).otherwise(_c(c).cast("double"))


def recode(c: Col, values: dict) -> Column:
    """The value's entry in ``values``; null without one."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.try_element_at(table, _c(c))


def decode_label(c: Col, labels: dict) -> Column:
    """The code's label as string, or the code itself."""
    return F.coalesce(recode(c, labels), _c(c).cast("string"))


def normalised_code(c: Col) -> Column:
    """Trimmed upper case; null stays null."""
    return F.upper(F.trim(_c(c).cast("string")))


def merged_codes(c: Col, pairs: dict[str, str]) -> Column:
    """Codes that ``pairs`` names replaced."""
    return F.coalesce(recode(c, pairs), _c(c)) if pairs else _c(c)


def normal_cdf(c: Col) -> Column:
    """Standard normal distribution function, by Abramowitz and Stegun 7.1.26 (error below 1.5e-7).

    Spark has no error function; the rational form stays inside generated code.
    """
    x = _c(c).cast("double")
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1.0 - poly * F.exp(-z * z)
    return 0.5 * (1.0 + F.when(x < 0, -erf).otherwise(erf))


def percentile_score(theta: Col) -> Column:
    """A standard normal trait as a percentile, one decimal."""
    return F.round(100.0 * normal_cdf(theta), 1)
