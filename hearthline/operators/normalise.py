"""Normalised listings from raw cards and details, and effective facts of a property."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.functions import text
from hearthline.functions.numbers import price_per_m2
from hearthline.operators.features import best_listing

CARD = ("title_raw", "price_raw", "currency_raw", "size_raw", "rooms_raw", "floor_raw", "location_raw")
DETAIL = (*CARD, "description_raw", "seller_raw", "agency_raw")


def normalised_listings(cards: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Fourteen facts per card; a detail's text wins where it is not blank. The currency may stand in the
    price text, and the floor, failing all else, in the description."""
    d = details.select(key, *(F.col(c).alias(f"d_{c}") for c in DETAIL))
    both = cards.join(d, key, "left")
    raw = {c: text.first_text(F.col(f"d_{c}"), F.col(c)) if c in CARD else text.first_text(F.col(f"d_{c}")) for c in DETAIL}
    raw["currency_raw"] = text.first_text(raw["currency_raw"], raw["price_raw"])
    raw["floor_raw"] = text.first_text(raw["floor_raw"], raw["description_raw"])
    r = both.select(key, *(c.alias(n) for n, c in raw.items()))
    price, size = text.parse_decimal(F.col("price_raw"), 2), text.parse_decimal(F.col("size_raw"), 2, 10)
    return r.select(
        key, F.col("title_raw").alias("title"), F.col("description_raw").alias("description"), price.alias("asking_price"),
        text.parse_currency(F.col("currency_raw")).alias("currency"), size.alias("size_m2"), price_per_m2(price, size).cast("decimal(14,2)").alias("price_per_m2"),
        text.city_of(F.col("location_raw")).alias("city"), F.col("location_raw").alias("location"), text.parse_decimal(F.col("rooms_raw"), 2, 5).alias("rooms"),
        text.parse_floor(F.col("floor_raw")).alias("floor"), text.parse_total_floors(F.col("floor_raw")).alias("total_floors"),
        text.parse_seller_type(F.col("seller_raw"), F.col("agency_raw")).alias("seller_type"), F.col("seller_raw").alias("seller_name"), F.col("agency_raw").alias("agency_name"),
    )


def effective_facts(properties: DataFrame, listings: DataFrame, fields: list[str]) -> DataFrame:
    """Each field and where it comes from: the property, else its best listing, else unknown."""
    both = properties.join(best_listing(listings), "property_id", "left")
    out = both
    for f in fields:
        source = F.when(F.col(f).isNotNull(), "property").when(F.col(f"best.{f}").isNotNull(), "listing").otherwise("unknown")
        out = out.withColumn(f"{f}_source", source).withColumn(f, F.coalesce(F.col(f), F.col(f"best.{f}")))
    return out.drop("best")


def apply_location(properties: DataFrame, located: DataFrame) -> DataFrame:
    """A finer precision replaces a coarser one, never the other way round. Both: property_id,
    micro_location, location_precision."""
    n = located.select("property_id", F.col("micro_location").alias("_micro"), F.col("location_precision").alias("_level"))
    finer = F.coalesce(text.precision_rank(F.col("_level")), F.lit(0)) > text.precision_rank(F.col("location_precision"))
    both = properties.join(n, "property_id", "left")
    return both.withColumn("micro_location", F.when(finer, F.col("_micro")).otherwise(F.col("micro_location"))).withColumn("location_precision", F.when(finer, F.col("_level")).otherwise(F.col("location_precision"))).drop("_micro", "_level")
