"""Liquidity score by additive rules, and fast-sale values. Unknown facts give no points but are named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.numbers import bands, clamp, half_up
from hearthline.operators.valuation import condition_level

# Sets of names, and discounts by level (low, base, high).
HIGH_DEMAND = ["a blok", "belville", "blok 21", "blok 30", "blok 45", "blok 63", "retencija", "savski kej", "yubc"]
COMMON_BUILDINGS = ["new", "new_building", "newer_building", "novogradnja", "standard"]
WEAK_BUILDINGS = ["baraka", "old", "stara gradnja", "suteren"]
DISCOUNTS = {"HIGH": (8, 6, 4), "MEDIUM": (12, 9, 7), "LOW": (18, 14, 10)}


def location_points(micro: Column, neighborhood: Column, municipality: Column, city: Column) -> Column:
    told = lambda c: F.coalesce(c.rlike(r"\S"), F.lit(False))
    return F.when(F.lower(F.trim(micro)).isin(HIGH_DEMAND), 14).when(told(micro), 8).when(told(neighborhood), 5).when(told(municipality) | told(city), -8)


def size_points(kind: Column, size: Column) -> Column:
    """Of other kinds than apartments any known size counts nothing."""
    by_size = F.when(size.between(35, 90), 12).when(((size >= 25) & (size < 35)) | ((size > 90) & (size <= 110)), 4).otherwise(-10)
    return F.when(size.isNotNull(), F.when(kind == "APARTMENT", by_size).otherwise(0))


def rooms_points(rooms: Column) -> Column:
    return F.when(rooms.between(1.5, 3.5), 6).when((rooms <= 1) | (rooms >= 5), -4).when(rooms.isNotNull(), 0)


def floor_points(floor: Column, elevator: Column) -> Column:
    return (
        F.when(floor.isNull(), None).when(elevator.isNull(), F.when(floor.between(1, 6), 3).otherwise(0))
        .when((floor >= 7) & ~elevator, -12).when((floor >= 4) & ~elevator, -8).when(floor.between(1, 6), 6)
        .when(floor == 0, -3).when((floor >= 7) & elevator, 2).otherwise(0)
    )


def condition_points(level: Column) -> Column:
    return F.when(level >= 4, 10).when(level == 3, 6).when(level == 2, -3).when(level == 1, -8).when(level == 0, -14)


def parking_points(parking: Column) -> Column:
    return F.when(parking, 3).when(~parking, -2)


def building_points(kind: Column) -> Column:
    low = F.lower(F.trim(kind))
    return F.when(low.isNull() | (low == ""), None).when(low.isin(COMMON_BUILDINGS), 4).when(low.isin(WEAK_BUILDINGS), -4).otherwise(0)


def asking_points(asking: Column, fair: Column) -> Column:
    r = F.when(fair > 0, asking / fair)
    return F.when(r <= 1.00, 3).when(r <= 1.05, 1).when(r > 1.15, -10).when(r.isNotNull(), 0)


def inventory_points(comps: Column) -> Column:
    return F.when(comps >= 8, 5).when(comps >= 4, 2).otherwise(-2)


def assess(points: dict[str, Column], also_unknown: dict[str, Column] | None = None) -> tuple[Column, Column, Column]:
    """Score 50 plus points within 0 and 100, the factors that have points, and the unknown ones: those whose
    points are null, and of also_unknown those that are."""
    score = clamp(F.lit(50) + sum((F.coalesce(p, F.lit(0)) for p in points.values()), F.lit(0)))
    factors = F.array_compact(F.array(*(F.when(p != 0, F.struct(F.lit(n).alias("code"), p.cast("int").alias("points"))) for n, p in points.items())))
    lacking = {n: p.isNull() for n, p in points.items()} | {n: c.isNull() for n, c in (also_unknown or {}).items()}
    unknown = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in lacking.items())))
    return score, factors, unknown


def level(score: Column) -> Column:
    return F.when(score >= 75, "HIGH").when(score >= 50, "MEDIUM").otherwise("LOW")


def confidence(valuation_conf: Column, quality: Column, unknown: Column, comps: Column) -> Column:
    known = F.greatest(F.lit(0), (9 - unknown) / 9)
    return half_up(clamp(10 + 0.35 * F.coalesce(valuation_conf, F.lit(0)) + 0.25 * F.coalesce(quality, F.lit(0)) + 25 * known + 5 * F.least(comps, F.lit(8)) / 8), 2, 5)


def discounts_pct(lvl: Column, conf: Column, dispersion_pct: Column, days: Column) -> dict[str, Column]:
    """Percent off for low, base and high values; at least 1."""
    extra = F.when(conf < 40, 4).when(conf < 60, 2).otherwise(0) + F.when(dispersion_pct > 15, 2).when(dispersion_pct > 8, 1).otherwise(0) + F.when(days <= 30, 2).when(days >= 90, -2).otherwise(0)
    pick = lambda k: F.when(lvl == "HIGH", DISCOUNTS["HIGH"][k]).when(lvl == "MEDIUM", DISCOUNTS["MEDIUM"][k]).otherwise(DISCOUNTS["LOW"][k])
    return {name: F.greatest(F.lit(1), pick(k) + extra) for k, name in enumerate(("low", "base", "high"))}


def sale_confidence(liquidity_conf: Column, valuation_conf: Column, days: Column) -> Column:
    return clamp(F.least(liquidity_conf, F.coalesce(valuation_conf, F.lit(0))) + bands(days, [(30, -5), (89, 0)], 2))


def assessed(targets: DataFrame, valuations: DataFrame, days: int = 60) -> DataFrame:
    """Liquidity and fast-sale values of every target: property_id, property_type, the facts of a valuation's
    target, asking_cents and quality. Where the valuation is missing or failed, so do both, with the reason."""
    if days <= 0:
        raise ValueError("days must be positive")
    c = F.col
    v = valuations.select("property_id", c("status").alias("v_status"), "fair_cents", "included_count", c("confidence").alias("v_confidence"), "dispersion", F.lit(True).alias("valued"))
    both = targets.join(v, "property_id", "left")
    reason = (
        F.when(c("valued").isNull(), "MISSING_SUCCESSFUL_VALUATION").when(c("v_status") != "SUCCESS", "VALUATION_INSUFFICIENT_DATA")
        .when(~F.coalesce(c("fair_cents") > 0, F.lit(False)), "MISSING_FAIR_VALUE_BASE")
    )
    points = {
        "location": location_points(c("micro"), c("neighborhood"), c("municipality"), c("city")), "size_m2": size_points(c("property_type"), c("size")),
        "rooms": rooms_points(c("rooms")), "floor": floor_points(c("floor"), c("elevator")), "condition": condition_points(condition_level(c("condition"))),
        "parking": parking_points(c("parking")), "building_type": building_points(c("building")), "asking_price_to_fair_value": asking_points(c("asking_cents"), c("fair_cents")),
        "inventory": inventory_points(c("included_count")),
    }
    score, factors, unknown = assess(points, {"elevator": c("elevator")})
    made = both.withColumns({"reason": reason, "score": score, "factors": factors, "unknown": unknown})
    sure = confidence(c("v_confidence"), c("quality"), F.size("unknown"), c("included_count")).cast("double")
    made = made.withColumns({"level": level(c("score")), "confidence": sure})
    off = discounts_pct(c("level"), c("v_confidence"), c("dispersion") * 100, F.lit(days))
    made = made.withColumns({f"off_{k}": x for k, x in off.items()})
    only = lambda x, name: F.when(c("reason").isNull(), x).alias(name)
    sale = [only(F.expr(f"(2 * fair_cents * (100 - off_{k}) + 100) div 200"), f"sale_{k}_cents") for k in off]
    return made.select(
        "property_id", F.when(c("reason").isNull(), "SUCCESS").otherwise("INSUFFICIENT_DATA").alias("status"), "reason", only(c("score"), "liquidity_score"), only(c("level"), "liquidity_level"),
        F.when(c("reason").isNull(), c("confidence")).otherwise(0.0).alias("confidence"), only(c("factors"), "factors"), only(c("unknown"), "unknown"), *sale,
        F.when(c("reason").isNull(), sale_confidence(c("confidence"), c("v_confidence"), F.lit(days))).otherwise(0.0).alias("sale_confidence"),
    )
