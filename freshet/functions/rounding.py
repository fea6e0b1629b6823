"""Operational rounding of discharge.

Half-even throughout (``bround``): bulletins are produced with that rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import _col

# Fixed values: (upper limit of the value, decimals kept) for three valid digits.
THREE_DIGITS = ((0.001, 6), (0.01, 5), (0.1, 4), (1.0, 3), (10.0, 2), (100.0, 1))
# The coarser steps of the printed bulletins.
BULLETIN_DIGITS = ((10.0, 2), (100.0, 1))
CLOSE_TO_ZERO = 1e-4


def stable_round(value, decimals: int) -> Column:
    """Half-even rounding of an aggregate.

    Partial aggregates add up in any order, so a result can miss a tie by a few ulps on
    one run and hit it on the next; rounding six digits further out first removes that.
    The second step scales, rounds to even and scales back, the way numeric arrays are
    rounded in the reference.
    """
    scale = F.lit(10.0**decimals)
    return F.rint(F.round(_col(value), decimals + 6) * scale) / scale


def _stepped(value: Column, steps, apply) -> Column:
    out = None
    for limit, decimals in steps:
        cond = value < limit
        out = F.when(cond, apply(decimals)) if out is None else out.when(cond, apply(decimals))
    return out.otherwise(apply(0))


def _fixed(value: Column, decimals: int) -> Column:
    return F.bround(value.cast("decimal(38,10)"), decimals).cast(f"decimal(38,{decimals})").cast("string")


def round_significant(value) -> Column:
    """Three valid digits; tiny and negative values become 0."""
    v = _col(value)
    rounded = _stepped(v, THREE_DIGITS, lambda n: F.bround(v, n))
    return F.when(v.isNull(), F.lit(None)).when(v <= CLOSE_TO_ZERO, F.lit(0.0)).otherwise(rounded)


def discharge_text(value) -> Column:
    """2 / 1 / 0 decimals as text; negative -> blank, zero -> '0'."""
    v = _col(value)
    text = _stepped(v, BULLETIN_DIGITS, lambda n: _fixed(v, n))
    return F.when(v < 0, " ").when(v == 0, "0").otherwise(text)


def bulletin_text(value) -> Column:
    """Traditional bulletin; zero and negative values print as '0.0'."""
    v = _col(value)
    text = _stepped(v, BULLETIN_DIGITS, lambda n: _fixed(v, n))
    return F.when(v <= CLOSE_TO_ZERO, "0.0").otherwise(text)


def bulletin_text_three_digits(value) -> Column:
    v = _col(value)
    text = _stepped(v, THREE_DIGITS, lambda n: _fixed(v, n))
    return F.when(v <= CLOSE_TO_ZERO, "0.0").otherwise(text)


def percent_of_norm(discharge, norm) -> Column:
    """M2: whole percent as text, blank outside 0..500."""
    share = _col(discharge) / F.nullif(_col(norm), F.lit(0.0)) * 100
    return F.when(share.between(0.0, 500.0), _fixed(share, 0)).otherwise(" ")


def discharge_range(discharge, delta) -> dict[str, Column]:
    """M3: printed lower and upper bound; blank when both are zero."""
    low = F.greatest(_col(discharge) - _col(delta), F.lit(0.0))
    high = F.greatest(_col(discharge) + _col(delta), F.lit(0.0))
    unknown = _col(discharge).isNull() | _col(delta).isNull()
    blank = unknown | ((low == 0) & (high == 0))
    return {
        "fc_qmin": F.when(blank, " ").otherwise(discharge_text(low)),
        "fc_qmax": F.when(blank, " ").otherwise(discharge_text(high)),
    }


def forecast_bounds(discharge, delta, kind: str = "delta", percent: float = 0.0, wider: bool = True) -> dict[str, Column]:
    """M6: bounds by delta, by +-percent, or by the wider (or narrower) of both."""
    q, d = _col(discharge), _col(delta)
    low_pct, high_pct = q * (1 - percent / 100.0), q * (1 + percent / 100.0)
    if kind == "delta":
        return {"fc_lower": q - d, "fc_upper": q + d}
    if kind == "percent":
        return {"fc_lower": low_pct, "fc_upper": high_pct}
    if kind != "max":
        raise ValueError(f"unknown range kind {kind!r}")
    outer, inner = (F.least, F.greatest) if wider else (F.greatest, F.least)
    known = q.isNotNull() & d.isNotNull()
    return {
        "fc_lower": F.when(known, outer(q - d, low_pct)),
        "fc_upper": F.when(known, inner(q + d, high_pct)),
    }
