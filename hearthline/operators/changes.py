"""Change data capture on listing snapshots: events, missing observations, reconciliation, run status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds.
STALE_JOB = 7200


def merged(new: Column, old: Column) -> Column:
    """A new value wins unless it is null."""
    return F.coalesce(new, old)


def merged_seller(new: Column, old: Column) -> Column:
    """UNKNOWN never overwrites a known type."""
    return F.when(new.isNull() | (new == "UNKNOWN"), F.coalesce(old, new)).otherwise(new)


# Columns of a listing that a new value overwrites where it is known; price and what goes with it move together.
FIELDS = ["title", "description", "size", "city_raw", "location_raw", "rooms", "floor", "total_floors", "seller_name", "agency_name"]
PRICED = ["price", "currency", "price_per_m2"]


def upserted(listings: DataFrame, snapshot: DataFrame, key: str, seen_at: Column) -> DataFrame:
    """The listings after a crawl. listings: key, FIELDS, PRICED, seller_type, status, misses, first_seen,
    last_seen, removed_at, last_detail_at; snapshot: key, FIELDS, PRICED, seller_type, detailed. What was seen
    is ACTIVE without misses; what was not stays as it was (missing() counts its misses)."""
    told = [*FIELDS, *PRICED, "seller_type", "detailed"]
    both = listings.join(snapshot.select(key, *(F.col(c).alias(f"n_{c}") for c in told), F.lit(True).alias("seen")), key, "full")
    seen = F.coalesce("seen", F.lit(False))
    here = lambda new, old: F.when(seen, new).otherwise(F.col(old)).alias(old)
    priced = seen & (F.col("n_price").isNotNull() | F.col("status").isNull())
    return both.select(
        key, *(merged(F.col(f"n_{c}"), F.col(c)).alias(c) for c in FIELDS), *(F.when(priced, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in PRICED),
        merged_seller(F.col("n_seller_type"), F.col("seller_type")).alias("seller_type"), here(F.lit("ACTIVE"), "status"), here(F.lit(0), "misses"),
        F.coalesce("first_seen", F.when(seen, seen_at)).alias("first_seen"), here(seen_at, "last_seen"), F.when(~seen, F.col("removed_at")).alias("removed_at"),
        F.when(seen & F.coalesce("n_detailed", F.lit(False)), seen_at).otherwise(F.col("last_detail_at")).alias("last_detail_at"),
    )


def snapshot_events(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, event_type, old_price, new_price): what a new snapshot says against the old one.

    Both have key, price, description, seller, status. A new key is DISCOVERED only; otherwise, in
    order: REAPPEARED (it was not ACTIVE), PRICE_CHANGED (both known, different), DESCRIPTION_CHANGED,
    SELLER_CHANGED (a known value differs from the old one)."""
    o = old.select(key, *(F.col(c).alias(f"old_{c}") for c in ("price", "description", "seller", "status")))
    both = new.join(o, key, "left")
    known = F.col("old_status").isNotNull()
    event = lambda cond, name, k: F.when(cond, F.struct(F.lit(k).alias("seq"), F.lit(name).alias("event_type")))
    events = F.array_compact(F.array(
        event(~known, "DISCOVERED", 0),
        event(known & (F.col("old_status") != "ACTIVE"), "REAPPEARED", 1),
        event(known & (F.col("old_price") != F.col("price")), "PRICE_CHANGED", 2),
        event(known & F.col("description").isNotNull() & ~F.col("description").eqNullSafe(F.col("old_description")), "DESCRIPTION_CHANGED", 3),
        event(known & F.col("seller").isNotNull() & ~F.col("seller").eqNullSafe(F.col("old_seller")), "SELLER_CHANGED", 4),
    ))
    each = both.select(key, "old_price", F.col("price").alias("new_price"), F.explode(events).alias("e"))
    return each.select(key, F.col("e.seq").alias("seq"), F.col("e.event_type").alias("event_type"), "old_price", "new_price")


def missing(listings: DataFrame, seen: DataFrame, key: str, complete: bool = True) -> DataFrame:
    """Listings not seen in a complete scan: misses counted up, NOT_SEEN, and whether this is the first miss
    (only that is an event). An incomplete scan says nothing."""
    gone = listings.join(seen.select(key), key, "left_anti") if complete else listings.limit(0)
    return gone.withColumn("first_miss", F.col("status") != "NOT_SEEN").withColumn("misses", F.col("misses") + 1).withColumn("status", F.lit("NOT_SEEN"))


def reconciled_status(status: Column, misses: Column, http: Column) -> Column:
    """After a re-fetch of what was missed twice or more: 404 and 410 mean removed, success active."""
    again = (status == "NOT_SEEN") & (misses >= 2)
    return F.when(again & http.isin(404, 410), "REMOVED").when(again & (http == 200), "ACTIVE").otherwise(status)


def http_category(code: Column) -> Column:
    return (
        F.when(code.isNull(), "network").when(code == 403, "forbidden").when(code == 429, "rate_limited")
        .when(code >= 500, "server_error").when(code >= 400, "client_error").otherwise("ok")
    )


def zero_result_anomaly(pages: Column, cards: Column, errors: Column) -> Column:
    return (pages > 0) & (cards == 0) & (errors == 0)


def job_status(pages: Column, cards: Column, errors: Column) -> Column:
    odd = zero_result_anomaly(pages, cards, errors)
    return F.when((errors == 0) & ~odd, "SUCCESS").when((cards > 0) | odd, "PARTIAL").otherwise("FAILED")


def source_health(status: Column, parse_errors: Column | None = None, http_errors: Column | None = None, odd: Column | None = None) -> Column:
    """A job that failed, or one that was partial, had errors of parsing or fetching, or found oddly nothing."""
    troubled = (status == "PARTIAL") | F.coalesce(odd if odd is not None else F.lit(False), F.lit(False))
    for errors in (parse_errors, http_errors):
        troubled = troubled if errors is None else troubled | F.coalesce(errors > 0, F.lit(False))
    return F.when(status == "FAILED", "FAILED").when(troubled, "DEGRADED").otherwise("HEALTHY")


def run_due(enabled: Column, last_attempt: Column, now: Column, interval_s: int = 1800) -> Column:
    waited = F.unix_micros(now) - F.unix_micros(last_attempt) >= interval_s * 1_000_000
    return enabled & (last_attempt.isNull() | waited)


def known_boundary(cards: DataFrame, market: str, position: str, known: str, threshold: int = 10) -> DataFrame:
    """Cards of each market up to where `threshold` known ids in a row have been met."""
    from hearthline.operators.rows import islands

    runs = islands(cards, [market], [position], F.col(known), "_run")
    stops = runs.filter(F.col("_run") == threshold).groupBy(market).agg(F.min(position).alias("_stop"))
    kept = runs.join(stops, market, "left").filter(F.col("_stop").isNull() | (F.col(position) <= F.col("_stop")))
    return kept.drop("_run", "_stop")
