"""Forcing and model arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import _col

KELVIN = 273.15


def linear_prediction(slope, predictor, intercept, clip: bool = False) -> Column:
    """M1; ``clip`` is the site-level rule that a forecast is never negative."""
    q = _col(slope) * _col(predictor) + _col(intercept)
    return F.when(q < 0, 0.0).otherwise(q) if clip else q


def power_transform(value, a, b) -> Column:
    return _col(a) * F.pow(_col(value), _col(b))


def map_precipitation(value, a, b, wet_day) -> Column:
    """M4: days at or below the wet-day threshold count as dry."""
    v = _col(value)
    return F.bround(power_transform(F.when(v <= _col(wet_day), F.lit(0.0)).otherwise(v), a, b), 2)


def map_temperature(value, a, b) -> Column:
    """M4: the transfer function acts on Kelvin."""
    return F.bround(power_transform(_col(value) + KELVIN, a, b) - KELVIN, 2)


def discharge_to_depth(discharge, area) -> Column:
    """M5: m3/s over ``area`` m2 -> mm per day."""
    return F.try_divide(_col(discharge), _col(area)) * 86400 * 1000


def depth_to_discharge(depth, area) -> Column:
    return _col(depth) * _col(area) / 86400 / 1000


def solar_declination(day_of_year) -> Column:
    return 0.409 * F.sin(2 * math.pi / 365 * _col(day_of_year) - 1.39)


def sunset_hour_angle(day_of_year, latitude_deg) -> Column:
    phi = F.radians(_col(latitude_deg))
    x = -F.tan(phi) * F.tan(solar_declination(day_of_year))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def daylight_hours(day_of_year, latitude_deg) -> Column:
    """M8: astronomical day length."""
    return sunset_hour_angle(day_of_year, latitude_deg) * (24 / math.pi)


def extraterrestrial_radiation(day_of_year, latitude_deg) -> Column:
    """MJ m-2 day-1, from the solar constant and the sun-earth distance."""
    doy, phi = _col(day_of_year), F.radians(_col(latitude_deg))
    distance = 1 + 0.033 * F.cos(2 * math.pi / 365 * doy)
    dec, omega = solar_declination(doy), sunset_hour_angle(doy, latitude_deg)
    geometry = omega * F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.sin(omega)
    return 24 * 60 / math.pi * 0.0820 * distance * geometry


def potential_evaporation(temperature, day_of_year, latitude_deg) -> Column:
    """M7: Oudin et al. (2005), mm per day; zero below -5 deg C."""
    t = _col(temperature)
    depth = extraterrestrial_radiation(day_of_year, latitude_deg) / 2.45 * (t + 5) / 100
    return F.when(t + 5 > 0, depth).otherwise(F.when(t.isNotNull(), 0.0))


def scaled(value, center, spread) -> Column:
    """M9: (x - mean) / std, or (x - min) / (max - min)."""
    return (_col(value) - _col(center)) / _col(spread)


def rescaled(value, center, spread) -> Column:
    """M9 inverse: two decimals, never negative."""
    return F.greatest(F.bround(_col(value) * _col(spread) + _col(center), 2), F.lit(0.0))


def cyclic_features(date) -> dict[str, Column]:
    """Sin / cos of day, week and month."""
    d = _col(date)
    out = {}
    for name, value, length in (
        ("day_of_year", F.dayofyear(d), 365),
        ("week", F.weekofyear(d), 52),
        ("month", F.month(d), 12),
    ):
        angle = 2 * math.pi * value / length
        out[f"{name}_sin"], out[f"{name}_cos"] = F.sin(angle), F.cos(angle)
    return out
