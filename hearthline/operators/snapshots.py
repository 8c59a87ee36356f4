"""Snapshots of a property as of a moment, paper deals and their outcomes; nothing later is seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.numbers import elapsed_days
from hearthline.operators.rows import asof_latest, left_fan


def property_snapshot(properties: DataFrame, analyses: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """Per property a struct of the latest row of each analysis (property_id, as_of, created_at, id, ...)."""
    parts = []
    for name, df in analyses.items():
        last = asof_latest(df, ["property_id"], "as_of", as_of, ["created_at", "id"])
        parts.append(last.select("property_id", F.struct(*[c for c in last.columns if c != "property_id"]).alias(name)))
    return left_fan(properties, parts, "property_id").withColumn("snapshot_at", as_of)


def shadow_deals(snapshots: DataFrame, min_profit: float) -> DataFrame:
    """Paper deals of snapshots whose deal is profitable enough, with the frozen inputs as JSON."""
    kept = snapshots.filter(F.col("deal").isNotNull() & (F.col("deal.profit") >= min_profit))
    return kept.select("property_id", F.col("snapshot_at").alias("opened_at"), F.col("deal.max_buy").alias("max_buy"), F.to_json(F.struct("deal", "valuation")).alias("input_snapshot"))


def outcomes(deals: DataFrame, known: DataFrame, as_of: Column) -> DataFrame:
    """Deals with their outcome as known at as_of: it happened and was recorded by then.

    OPEN without one (or still on sale), UNKNOWN without a price, else MEASURED."""
    seen = known.filter((F.col("outcome_date") <= as_of) & (F.col("created_at") <= as_of))
    last = asof_latest(seen, ["property_id"], "outcome_date", as_of, ["created_at", "id"])
    both = deals.join(last, "property_id", "left")
    status = F.when(F.col("outcome_type").isNull() | (F.col("outcome_type") == "STILL_ACTIVE"), "OPEN").when(F.col("sale_price").isNull(), "UNKNOWN").otherwise("MEASURED")
    return both.withColumn("status", status).withColumn("days_open", elapsed_days(F.coalesce("outcome_date", as_of), F.col("opened_at")))


def is_positive(outcome: Column, sale_price: Column, max_buy: Column) -> Column:
    """Whether an outcome shows that the call was worth it; null where it tells nothing."""
    return F.when(outcome == "BOUGHT_BY_USER", True).when(outcome.isin("LOST_TO_OTHER_BUYER", "SALE_CANCELLED"), False).when(outcome.isin("CONFIRMED_SOLD", "LIKELY_SOLD"), sale_price <= max_buy)
