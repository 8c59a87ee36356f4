"""Number, ratio, date and geometry rules as column expressions; decimals round half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.77
MICROS_PER_DAY = 86_400_000_000


def bands(x: Column, steps: list[tuple[object, object]], otherwise: object, unknown: object = None) -> Column:
    """The value of the first step (bound, value) with x <= bound, else otherwise; unknown for null."""
    out = F.when(x.isNull(), F.lit(unknown))
    for bound, value in steps:
        out = out.when(x <= bound, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def at_least(x: Column, steps: list[tuple[object, object]], otherwise: object, unknown: object = None) -> Column:
    """As bands, with x >= bound."""
    out = F.when(x.isNull(), F.lit(unknown))
    for bound, value in steps:
        out = out.when(x >= bound, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def half_up(x: Column, scale: int, precision: int = 14) -> Column:
    return F.round(x.cast("decimal(38,10)"), scale).cast(f"decimal({precision},{scale})")


def floor_cents(x: Column) -> Column:
    return F.floor(x * 100) / 100


def clamp(x: Column, low: object = 0, high: object = 100) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def price_per_m2(price: Column, size: Column) -> Column:
    return F.when(size > 0, F.round(price / size, 2))


def drop_pct(old: Column, new: Column) -> Column:
    """Percent of a price cut, four digits; 0 if it is none."""
    return F.when((old > 0) & (new < old), F.round((old - new) / old * 100, 4)).otherwise(0)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole periods of 24 hours, at least 0."""
    return F.greatest(F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / MICROS_PER_DAY), F.lit(0)).cast("int")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(h))


def known_weighted_mean(terms: list[tuple[Column, object]]) -> Column:
    """Weighted mean of the terms that are not null, their weights rescaled; null if all are."""
    total = sum((F.when(x.isNotNull(), x * w).otherwise(0) for x, w in terms), F.lit(0))
    weight = sum((F.when(x.isNotNull(), F.lit(w)).otherwise(0) for x, w in terms), F.lit(0))
    return F.when(weight > 0, total / weight)


def jaccard(a: Column, b: Column) -> Column:
    """0 where nothing is common, also for empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def nearest(over: Column, under: Column) -> Column:
    """The whole number nearest to over / under of whole numbers, halves up; null where under is 0."""
    return F.floor(F.try_divide(2 * over + under, 2 * under)).cast("long")
