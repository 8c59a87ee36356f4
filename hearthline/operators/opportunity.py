"""The opportunity decision: score, gates, action and reasons, ranking; alerts and their deliveries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.numbers import bands, clamp
from hearthline.functions.text import canonical_json

# Weights of the score, thresholds, priorities.
WEIGHTS = {"return": 0.30, "downside": 0.25, "roi": 0.15, "negotiation": 0.10, "liquidity": 0.10, "valuation": 0.05, "seller": 0.05}
CALL_SCORE, CALL_PCT, URGENT_SCORE, URGENT_PCT, WATCH_PCT, STRONG = 65, 0.10, 82, 0.03, 0.20, 1.5
DEFAULT_PROFIT, DEFAULT_DOWNSIDE, DEFAULT_ROI = 25000, 10000, 0.15
PRIORITY = {"URGENT_CALL": 100, "CALL": 80, "REVIEW": 50, "WATCH": 30, "IGNORE": 0}
MOST_ATTEMPTS, BATCH = 3, 50


def negotiation_points(pct: Column) -> Column:
    return bands(pct, [(0, 100), (0.03, 90), (0.10, 75), (0.20, 45)], 10, 0)


def component(value: Column, reference: Column) -> Column:
    return clamp(value / reference * 100)


def score(parts: dict[str, Column]) -> Column:
    return F.round(sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0)).cast("decimal(20,8)"), 2)


def ranking(profit: Column, downside: Column, roi: Column, per_day: Column, negotiation: Column) -> Column:
    up = lambda x: F.greatest(x, F.lit(0))
    return F.greatest(F.lit(0), up(profit) + 2 * up(downside) + 100_000 * up(roi) + 1_000_000 * up(F.coalesce(per_day, F.lit(0))) - 0.5 * negotiation)


def issues(checks: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in checks)))


def action(gate: Column, missing: Column, low_confidence: Column, economic: Column, negotiation_pct: Column, total: Column, signals: Column, strong: Column) -> Column:
    """The cascade; missing, low_confidence and economic are arrays of codes, signals a number."""
    within = lambda p: F.coalesce(negotiation_pct <= p, F.lit(False))
    has = lambda code: F.array_contains(economic, code)
    failed = F.when(has("NEGATIVE_EXPECTED_PROFIT"), "IGNORE").when(has("DOWNSIDE_PROFIT_BELOW_MIN") | has("ROI_BELOW_MIN"), "REVIEW").when(within(WATCH_PCT), "WATCH").otherwise("IGNORE")
    call = within(CALL_PCT) & (total >= CALL_SCORE)
    return (
        F.when(gate == "BLOCK", "IGNORE").when(F.size(missing) > 0, "REVIEW").when(F.size(low_confidence) > 0, "REVIEW")
        .when(F.size(economic) > 0, failed).when(gate == "VERIFY", F.when(call, "CALL").otherwise("REVIEW"))
        .when(within(URGENT_PCT) & (total >= URGENT_SCORE) & ((signals > 0) | strong), "URGENT_CALL")
        .when(call, "CALL").when(within(WATCH_PCT) | (signals > 0), "WATCH").otherwise("IGNORE")
    )


def priority(act: Column) -> Column:
    return reduce(lambda o, k: F.when(act == k, PRIORITY[k]).otherwise(o), PRIORITY, F.lit(0))


# Days in which a listing is new and a price cut recent, and the cut that is large.
NEW_DAYS, CUT_DAYS, LARGE_CUT = 3, 14, 0.05
# Parts of the summary that tell one state of a decision from another.
HASHED = ["asking_price", "downside_profit", "expected_profit", "fast_sale_base", "fmv_range", "liquidity_score", "max_buy_price", "property_id", "required_negotiation_pct", "risk_gate", "roi", "seller_motivation", "time_sensitive_signals", "valuation_confidence"]
RULES_VERSION = "opportunity_rules_v1"


def listing_context(listings: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """(property_id, active_listing_id, signals, last_change): the cheapest active listing (the latest of equal
    ones), whether it is new, and the last recent price cut. listings: property_id, listing_id, status, price,
    first_seen; events: property_id, event_id, event_type, detected_at, old_price, new_price."""
    within = lambda c, days: (F.col(c) >= as_of - F.make_dt_interval(F.lit(days))) & (F.col(c) <= as_of)
    cheapest = F.struct(F.coalesce(-F.col("price").cast("double"), F.lit(float("-inf"))), "first_seen", "listing_id")
    active = listings.filter("status = 'ACTIVE'").groupBy("property_id").agg(F.max_by(F.struct("listing_id", "first_seen"), cheapest).alias("l"))
    cut = (F.col("event_type") == "PRICE_CHANGED") & (F.col("old_price") > 0) & (F.col("new_price") < F.col("old_price")) & within("detected_at", CUT_DAYS)
    cuts = events.filter(cut).groupBy("property_id").agg(F.max(F.struct("detected_at", "event_id", "old_price", "new_price")).alias("c"))
    both = active.join(cuts, "property_id", "full")
    share = (F.col("c.old_price") - F.col("c.new_price")) / F.col("c.old_price")
    new = F.coalesce(F.col("l.first_seen") >= as_of - F.make_dt_interval(F.lit(NEW_DAYS)), F.lit(False))
    percent = F.concat(F.round((share * 100).cast("decimal(20,6)"), 1).cast("decimal(20,1)").cast("string"), F.lit("%"))
    told = F.concat(F.lit("Price cut "), percent, F.lit(" on "), F.date_format("c.detected_at", "yyyy-MM-dd"))
    signals = F.array_compact(F.array(F.when(new, "NEW_LISTING"), F.when(share >= LARGE_CUT, "LARGE_RECENT_PRICE_CUT")))
    return both.select("property_id", F.col("l.listing_id").alias("active_listing_id"), signals.alias("signals"), F.coalesce(told, F.when(new, "New listing")).alias("last_change"))


def minimum_data_issues(c: dict[str, Column]) -> Column:
    """Codes of what a decision lacks. c: deal_status, has_investment, has_cost, valuation_status, fair_value,
    fast_sale_status, sale_low, sale_base, sale_high, liquidity_status, liquidity_score, risk_gate, size,
    location, and the metrics of a deal."""
    positive = lambda *names: F.coalesce(F.least(*(F.when(c[n] > 0, 1).otherwise(0) for n in names)) == 1, F.lit(False)) if len(names) > 1 else F.coalesce(c[names[0]] > 0, F.lit(False))
    done = c["deal_status"] == "SUCCESS"
    metrics = {
        "MISSING_ASKING_PRICE": "asking_price", "MISSING_MAX_BUY_PRICE": "max_buy_price", "MISSING_REQUIRED_NEGOTIATION": "negotiation_pct",
        "MISSING_EXPECTED_PROFIT": "expected_profit", "MISSING_DOWNSIDE_PROFIT": "downside_profit", "MISSING_ROI": "roi",
    }
    succeeded = lambda name: F.coalesce(c[name] == "SUCCESS", F.lit(False))
    return issues([
        ("MISSING_DEAL_ANALYSIS", c["deal_status"].isNull()), ("INSUFFICIENT_DEAL_DATA", ~done), ("MISSING_INVESTMENT_PROFILE", ~c["has_investment"]), ("MISSING_COST_PROFILE", ~c["has_cost"]),
        ("MISSING_SUCCESSFUL_VALUATION", ~(succeeded("valuation_status") & positive("fair_value"))), ("MISSING_SUCCESSFUL_FAST_SALE", ~(succeeded("fast_sale_status") & positive("sale_low", "sale_base", "sale_high"))),
        ("MISSING_SUCCESSFUL_LIQUIDITY", ~(succeeded("liquidity_status") & c["liquidity_score"].isNotNull())), ("MISSING_RISK_ASSESSMENT", c["risk_gate"].isNull()),
        ("MISSING_USABLE_SIZE", ~positive("size")), ("MISSING_USABLE_LOCATION", F.coalesce(c["location"], F.lit("")) == ""), *((code, done & c[name].isNull()) for code, name in metrics.items()),
    ])


def confidence_issues(valuation_confidence: Column, least_valuation: Column, liquidity_score: Column, least_liquidity: Column) -> Column:
    return issues([("VALUATION_CONFIDENCE_BELOW_MIN", valuation_confidence < least_valuation), ("MISSING_LIQUIDITY_SCORE", liquidity_score.isNull()), ("LIQUIDITY_BELOW_MIN", liquidity_score < least_liquidity)])


def economic_issues(profit: Column, downside: Column, roi: Column, least_profit: Column, least_downside: Column, least_roi: Column) -> Column:
    return issues([("NEGATIVE_EXPECTED_PROFIT", profit < 0), ("EXPECTED_PROFIT_BELOW_MIN", profit < least_profit), ("DOWNSIDE_PROFIT_BELOW_MIN", downside < least_downside), ("ROI_BELOW_MIN", roi < least_roi)])


def money(value: Column) -> Column:
    """EUR and the whole amount in groups of three, rounded half up."""
    whole = F.round(value.cast("decimal(20,4)"), 0).cast("long")
    return F.concat(F.lit("EUR "), F.format_number(whole, 0))


def plain_number(value: Column) -> Column:
    """A decimal without zeros at its end."""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def property_label(size: Column, rooms: Column, floor: Column, floors: Column, elevator: Column) -> Column:
    high = F.when(floor.isNotNull() & floors.isNotNull(), F.concat(floor.cast("string"), F.lit("/"), floors.cast("string"))).when(floor.isNotNull(), floor.cast("string")).otherwise("UNKNOWN floor")
    part = lambda x, unit: F.concat(F.coalesce(plain_number(x), F.lit("UNKNOWN")), F.lit(f" {unit}"))
    return F.concat_ws(" | ", part(size, "m2"), part(rooms, "rooms"), high, F.when(elevator, "lift"))


def location_label(city: Column, municipality: Column, micro: Column, neighborhood: Column) -> Column:
    told = lambda x: F.when(x != "", x)
    label = F.concat_ws(" - ", told(city), told(municipality), F.coalesce(told(micro), told(neighborhood)))
    return F.when(label != "", label)


def decision_summary(c: dict[str, Column]) -> Column:
    """The struct that a decision shows. c: property_id, location, property, prices and values (decimals),
    roi, negotiation_pct, scores and levels, and the listing context."""
    told = lambda x: x.cast("string")
    ranged = F.concat(money(c["fair_low"]), F.lit("-"), money(c["fair_high"]))
    parts = {
        "property_id": told(c["property_id"]), "location": F.coalesce(c["location"], F.lit("UNKNOWN")), "property": c["property"], "asking_price": money(c["asking_price"]), "fmv_range": ranged,
        "fast_sale_base": money(c["sale_base"]), "max_buy_price": money(c["max_buy_price"]), "expected_profit": money(c["expected_profit"]), "downside_profit": money(c["downside_profit"]), "roi": told(c["roi"]),
        "required_negotiation_pct": told(c["negotiation_pct"]), "liquidity_score": told(c["liquidity_score"]), "valuation_confidence": told(c["valuation_confidence"]),
        "seller_motivation": F.coalesce(c["seller_motivation"], F.lit("UNKNOWN")), "risk_gate": F.coalesce(c["risk_gate"], F.lit("UNKNOWN")), "market_age_days": c["market_age_days"],
        "last_change": c["last_change"], "time_sensitive_signals": c["signals"], "active_listing_id": told(c["active_listing_id"]),
    }
    return F.struct(*(x.alias(n) for n, x in parts.items()))


def state_hash(summary: Column, property_id: Column, act: Column, reasons: Column, total: Column, rank: Column) -> Column:
    """A digest of what a decision says; equal decisions have equal digests, whatever else has changed."""
    stable = canonical_json({n: summary[n] for n in HASHED}, lists={"time_sensitive_signals"})
    told = {"property_id": property_id.cast("string"), "ranking_value": rank.cast("string"), "recommended_action": act, "score": total.cast("string"), "rules_version": F.lit(RULES_VERSION)}
    return F.sha2(canonical_json(told | {"reason_codes": reasons}, lists={"reason_codes"}, raw={"decision_summary": stable}).cast("binary"), 256)


def batch_status(alerts: DataFrame) -> DataFrame:
    """One row: whether a batch has raised any alert."""
    return alerts.agg(F.count("*").alias("alerts")).withColumn("status", F.when(F.col("alerts") > 0, "QUALIFYING_OPPORTUNITIES").otherwise("NO_QUALIFYING_OPPORTUNITIES"))


def new_alerts(decisions: DataFrame, existing: DataFrame) -> DataFrame:
    """One alert per dedupe_key for calls; none that exists already."""
    calls = decisions.filter(F.col("action").isin("CALL", "URGENT_CALL")).withColumn("priority", priority(F.col("action")))
    return calls.dropDuplicates(["dedupe_key"]).join(existing.select("dedupe_key"), "dedupe_key", "left_anti")


def due_alerts(alerts: DataFrame) -> DataFrame:
    """The next batch to deliver: pending or failed with attempts left, first created first."""
    return alerts.filter(F.col("status").isin("PENDING", "FAILED") & (F.col("attempts") < MOST_ATTEMPTS)).orderBy("created_at", "alert_id").limit(BATCH)


def delivered(alerts: DataFrame, ok: Column) -> DataFrame:
    """The alerts after an attempt."""
    return alerts.withColumn("attempts", F.col("attempts") + 1).withColumn("status", F.when(ok, "SENT").otherwise("FAILED"))


def cooled(events: DataFrame, keys: list[str], at: str, ident: str, seconds: int = 21600) -> DataFrame:
    """Events that become alerts: a key's next alert is at least `seconds` after its last *alert*. Events without a time all are.

    Times and ids alone are dealt by key, sorted by Spark, and passed over once: a task keeps the last alert of the key
    that it is at, however many keys and events there are."""
    slim = events.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.unix_micros(at).alias("_t"), F.col(ident).cast("long").alias("_i"))
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = slim.columns[: len(keys)]
    dealt = slim.repartition(n, *names).sortWithinPartitions(*names, "_t", "_i")

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, free = None, None
        for batch in batches:
            told = []
            for key, t, i in zip(zip(*(batch[k].to_pylist() for k in names), strict=True), batch["_t"].to_pylist(), batch["_i"].to_pylist(), strict=True):
                if key != here:
                    here, free = key, None
                if t is None or free is None or t >= free:
                    told.append(i)
                    free = free if t is None else t + seconds * 1_000_000
            yield pa.RecordBatch.from_pydict({"_i": pa.array(told, pa.int64())})

    kept = dealt.mapInArrow(walk, "_i long")
    return events.join(kept.withColumnRenamed("_i", ident), ident, "left_semi")
