"""Market features of a property from its listings and price events, and its data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.numbers import drop_pct, elapsed_days

# Points of the data-quality score.
QUALITY_POINTS = {"location": 20, "size": 15, "price": 10, "rooms": 8, "floor": 7, "elevator": 7, "condition": 10, "year": 4, "building": 4, "heating": 3, "parking": 5, "description": 4, "images": 3}


def listing_aggregates(listings: DataFrame, as_of: Column) -> DataFrame:
    """Per property: counts, price range of active listings, ages, relists, sellers."""
    c = F.col
    active = c("status") == "ACTIVE"
    priced = F.when(active & (c("price") > 0), c("price"))
    first_active, first_any = F.max(F.when(active, c("first_seen"))), F.max("first_seen")
    return listings.groupBy("property_id").agg(
        F.count_if(active).alias("active_count"), F.count("*").alias("known_count"), F.min(priced).alias("lowest_price"), F.max(priced).alias("highest_price"),
        elapsed_days(as_of, F.coalesce(first_active, first_any)).alias("listing_age_days"), elapsed_days(as_of, F.min("first_seen")).alias("market_age_days"),
        F.greatest(F.count("*") - 1, F.lit(0)).alias("relist_count"), F.coalesce(F.bool_or(active & (c("seller") == "OWNER")), F.lit(False)).alias("owner_present"),
        F.count_if(active & (c("seller") == "AGENCY")).alias("agency_count"),
    )


def price_cuts(events: DataFrame, key: str, as_of: Column, drop=drop_pct) -> DataFrame:
    """Per key, of price changes that lower it: count, total, 7-day, 30-day and largest percent.
    A window's total goes from the first old price to the lowest new one inside it."""
    cuts = events.filter("new_price < old_price")
    inside = lambda n: F.col("at") >= as_of - F.expr(f"INTERVAL {n} DAYS")

    def total(where: Column | None) -> Column:
        pick = lambda x: x if where is None else F.when(where, x)
        return F.coalesce(drop(F.min(pick(F.struct("at", "event_id", "old_price")))["old_price"], F.min(pick(F.col("new_price")))), F.lit(0))

    return cuts.groupBy(key).agg(
        F.count("*").alias("cut_count"), total(None).alias("total_pct"), total(inside(7)).alias("pct_7d"), total(inside(30)).alias("pct_30d"),
        F.max(drop(F.col("old_price"), F.col("new_price"))).alias("largest_pct"), F.max("at").alias("last_cut_at"),
    )


def market_features(listings: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """The sixteen market features of every property with a listing. listings: as of listing_aggregates, with
    size; events: price changes with property_id, at, event_id, old_price, new_price."""
    seen = listing_aggregates(listings, as_of)
    sized = listings.groupBy("property_id").agg(F.max("size").alias("size"))
    both = seen.join(sized, "property_id").join(price_cuts(events, "property_id", as_of), "property_id", "left")
    c = F.col
    known = lambda name: F.coalesce(c(name), F.lit(0)).alias(name)
    return both.select(
        "property_id", F.when(c("size") > 0, F.round(c("lowest_price") / c("size"), 2)).alias("price_per_m2"), "listing_age_days", "market_age_days", "active_count", "known_count", "relist_count", "lowest_price", "highest_price",
        known("total_pct"), known("pct_7d"), known("pct_30d"), known("cut_count"), elapsed_days(as_of, c("last_cut_at")).alias("days_since_cut"), "largest_pct", "owner_present", "agency_count",
    )


def versioned(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of existing whose keys (an id and a version) new has not."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def location_points(micro: Column, confidence: Column, neighborhood: Column, municipality: Column, city: Column) -> Column:
    return (
        F.when(micro.isNotNull() & (confidence >= 0.75), 20).when(micro.isNotNull() | neighborhood.isNotNull(), 14)
        .when(municipality.isNotNull(), 8).when(city.isNotNull(), 4).otherwise(0)
    )


def description_points(text: Column) -> Column:
    n = F.length(F.trim(text))
    return F.when(text.isNull() | (n == 0), 0).when(n >= 80, 5).when(n >= 20, 3).otherwise(1)


def quality(known: dict[str, Column], location: Column) -> tuple[Column, Column]:
    """Score from 0 to 100 and the names of what is missing. known: by name, whether it is known."""
    score = location + sum((F.when(ok, QUALITY_POINTS[name]).otherwise(0) for name, ok in known.items()), F.lit(0))
    missing = F.array_compact(F.array(F.when(location == 0, F.lit("location")), *(F.when(~ok, F.lit(name)) for name, ok in known.items())))
    return score, missing


def best_listing(listings: DataFrame) -> DataFrame:
    """Per property the listing that lends it unknown facts: active first, then last seen, then the eldest."""
    rank = F.struct((F.col("status") == "ACTIVE").cast("int"), "last_seen", -F.unix_micros("created_at"))
    return listings.groupBy("property_id").agg(F.max_by(F.struct(*[c for c in listings.columns if c != "property_id"]), rank).alias("best"))


def longest_text(listings: DataFrame, key: str, text: str, ident: str) -> DataFrame:
    """Per key the longest text; of equal ones the one of the least id."""
    return listings.groupBy(key).agg(F.max_by(text, F.struct(F.coalesce(F.length(text), F.lit(-1)), -F.col(ident))).alias(text))


def fill_unknown(target: DataFrame, source: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields of target that are null take source's value."""
    s = source.select(key, *(F.col(f).alias(f"_s_{f}") for f in fields))
    out = target.join(s, key, "left")
    return out.withColumns({f: F.coalesce(f, f"_s_{f}") for f in fields}).drop(*(f"_s_{f}" for f in fields))
