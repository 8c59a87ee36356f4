"""Watch rules, re-analysis, module states, the acquisition pipeline and operational checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Modules that an event makes stale; ranks of pipeline states.
INVALIDATES = {"PRICE_CHANGED": ["deal", "opportunity"], "DESCRIPTION_CHANGED": ["llm", "seller", "risk", "deal", "opportunity"], "SELLER_CHANGED": ["seller", "risk", "deal", "opportunity"]}
PIPELINE_RANK = {"NEW": 0, "REVIEWED": 10, "CALLED": 20, "VISIT_SCHEDULED": 30, "VISITED": 40, "DUE_DILIGENCE": 50, "OFFERED": 60, "NEGOTIATING": 70, "WON": 80, "LOST": 80, "SOLD": 80, "SKIPPED": 80}
TERMINAL = 80


def rule_fires(kind: Column, threshold: Column, old: Column, new: Column) -> Column:
    """Price rules. A price below is a crossing; a drop threshold below 1 is a ratio, else a percent."""
    below = (new <= threshold) & (old.isNull() | (old > threshold))
    drop = F.when(old > 0, (old - new) / old * 100)
    wanted = F.when(threshold >= 1, threshold).otherwise(threshold * 100)
    hit = F.when(kind == "ANY_PRICE_CHANGE", ~old.eqNullSafe(new)).when(kind == "PRICE_BELOW", below).when(kind == "PRICE_DROP_PERCENT", drop >= wanted)
    return F.coalesce(hit, F.lit(False))


# Events that a rule without a type is after, and the one that each other type is after.
RELEVANT = ["PRICE_CHANGED", "DESCRIPTION_CHANGED", "SELLER_CHANGED"]
EVENT_OF = {"ANY_PRICE_CHANGE": "PRICE_CHANGED", "PRICE_BELOW": "PRICE_CHANGED", "PRICE_DROP_PERCENT": "PRICE_CHANGED", "DESCRIPTION_CHANGE": "DESCRIPTION_CHANGED", "SELLER_CHANGE": "SELLER_CHANGED"}
# Actions from the least to the most urgent.
ACTIONS = ["IGNORE", "WATCH", "REVIEW", "CALL", "URGENT_CALL"]


def rule_matches(kind: Column, threshold: Column, event_type: Column, old: Column, new: Column) -> Column:
    """Whether an event is what a rule is after: price rules by prices, others by the kind of event."""
    event = F.create_map(*(F.lit(x) for pair in EVENT_OF.items() for x in pair))
    right = F.when(kind.isNull(), event_type.isin(RELEVANT)).otherwise(F.try_element_at(event, kind) == event_type)
    priced = kind.isin("PRICE_BELOW", "PRICE_DROP_PERCENT")
    return F.coalesce(right, F.lit(False)) & F.when(F.coalesce(priced, F.lit(False)), rule_fires(kind, threshold, old, new)).otherwise(True)


def valid_rule(kind: Column, threshold: Column) -> Column:
    """Rules with a threshold need a positive one."""
    return ~F.coalesce(kind.isin("PRICE_BELOW", "PRICE_DROP_PERCENT"), F.lit(False)) | F.coalesce(threshold > 0, F.lit(False))


def triggers(rules: DataFrame, events: DataFrame) -> DataFrame:
    """Rules of property_id met by its events (of PRICE_CHANGED if they have no event_type), one per rule and
    change key."""
    events = events if "event_type" in events.columns else events.withColumn("event_type", F.lit("PRICE_CHANGED"))
    met = events.join(rules.filter("is_active"), "property_id").filter(rule_matches(F.col("rule_type"), F.col("threshold"), F.col("event_type"), F.col("old_price"), F.col("new_price")))
    change = F.concat_ws(":", "event_id", F.coalesce("rule_type", F.lit("DEFAULT")), F.coalesce(F.col("threshold").cast("string"), F.lit("default")))
    return met.withColumn("change_key", change).dropDuplicates(["rule_id", "change_key"])


def action_rank(act: Column) -> Column:
    """How urgent an action is; -1 for none."""
    return reduce(lambda o, k: F.when(act == ACTIONS[k], k).otherwise(o), range(len(ACTIONS)), F.lit(-1))


def what_changed(event_type: Column, rule_type: Column, threshold: Column, old: Column, new: Column, before: Column, after: Column) -> Column:
    """What a trigger tells: the change in words, the actions before and after it, and whether they are an upgrade."""
    told = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    words = (
        F.when(event_type == "PRICE_CHANGED", F.concat(F.lit("Price changed from "), told(old), F.lit(" to "), told(new)))
        .when(event_type == "DESCRIPTION_CHANGED", "Description changed").when(event_type == "SELLER_CHANGED", "Seller changed").otherwise(event_type)
    )
    drop = F.when((event_type == "PRICE_CHANGED") & (old > 0) & (new < old), F.round(((old - new) / old * 100).cast("decimal(20,8)"), 4))
    return F.struct(
        event_type.alias("event_type"), F.coalesce(rule_type, F.lit("DEFAULT")).alias("trigger_type"), threshold.cast("string").alias("threshold"), words.alias("summary_text"), drop.alias("price_drop_pct"),
        before.alias("previous_action"), after.alias("new_action"), (action_rank(after) > action_rank(before)).alias("action_upgraded"),
    )


def active_rules(rules: DataFrame) -> DataFrame:
    """The latest rule of a property, if it is active."""
    turn = F.row_number().over(Window.partitionBy("property_id").orderBy(F.desc("created_at"), F.desc("rule_id")))
    return rules.withColumn("_turn", turn).filter("_turn = 1 and is_active").drop("_turn")


def stale_modules(event_type: Column) -> Column:
    return reduce(lambda o, k: F.when(event_type == k, F.array(*map(F.lit, INVALIDATES[k]))).otherwise(o), INVALIDATES, F.array().cast("array<string>"))


def module_status(done_at: Column, input_at: Column, status: Column) -> Column:
    return (
        F.when(done_at.isNull(), "NOT_RUN").when(input_at > done_at, "STALE").when(status == "INSUFFICIENT_DATA", "INSUFFICIENT_DATA")
        .when(status.isin("FAILED", "INVALID_OUTPUT"), "FAILED").when(status == "PENDING", "PENDING").otherwise("SUCCESS")
    )


def pipeline_rank(status: Column) -> Column:
    return reduce(lambda o, k: F.when(status == k, PIPELINE_RANK[k]).otherwise(o), PIPELINE_RANK, F.lit(None).cast("int"))


def pipeline_state(steps: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Per key the state after its steps: it never falls in rank, and the first terminal one stays.

    That is the first step of the highest rank, so a struct maximum says it without a fold."""
    turn = F.struct(*(-F.col(c).cast("long") for c in order))
    known = steps.withColumn("_rank", pipeline_rank(F.col("status"))).filter("_rank is not null")
    best = known.groupBy(key).agg(F.max(F.struct(F.col("_rank"), turn.alias("_turn"), F.col("status"))).alias("b"), F.count("*").alias("steps"))
    return best.select(key, F.col("b.status").alias("status"), F.col("b._rank").alias("rank"), "steps")


def offer_status(response: Column, counter: Column) -> Column:
    return F.when(response == "ACCEPTED", "WON").when(response.isin("REJECTED", "WITHDRAWN", "EXPIRED"), "LOST").when((response == "COUNTERED") | counter.isNotNull(), "NEGOTIATING").otherwise("OFFERED")


def outcome_status(outcome: Column) -> Column:
    return F.when(outcome == "BOUGHT_BY_USER", "WON").when(outcome == "LOST_TO_OTHER_BUYER", "LOST").when(outcome.isin("CONFIRMED_SOLD", "LIKELY_SOLD"), "SOLD")


def valid_estimate(low: Column, base: Column, high: Column) -> Column:
    """Known estimates are not negative and in order; unknown ones pass."""
    return ~F.coalesce((F.least(low, base, high) < 0), F.lit(False)) & ~F.coalesce(low > base, F.lit(False)) & ~F.coalesce(base > high, F.lit(False))


def valid_offer(amount: Column, counter: Column) -> Column:
    return F.coalesce(amount > 0, F.lit(False)) & F.coalesce(counter >= 0, F.lit(True))


def accepted(commands: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Commands that are valid and those that are not; nothing is dropped silently."""
    return commands.filter(F.coalesce(ok, F.lit(False))), commands.filter(~F.coalesce(ok, F.lit(False)))


def call_matters(feedback: list[Column]) -> Column:
    """Whether a call or visit said anything that an analysis reads."""
    return F.coalesce(*(F.when(c.isNotNull(), F.lit(True)) for c in feedback), F.lit(False))


def classified(positive: Column, called: Column) -> Column:
    """Outcome against decision; UNKNOWN where there is no outcome."""
    return F.when(positive.isNull(), "UNKNOWN").when(positive & called, "TRUE_POSITIVE").when(positive, "FALSE_NEGATIVE").when(called, "FALSE_POSITIVE").otherwise("TRUE_NEGATIVE")


def stale_jobs(jobs: DataFrame, now: Column, seconds: int = 7200) -> DataFrame:
    return jobs.filter((F.col("status") == "RUNNING") & (F.unix_micros(now) - F.unix_micros("started_at") > seconds * 1_000_000)).withColumn("status", F.lit("FAILED"))


def source_alert(health: Column, last_success: Column, now: Column, stale_s: int = 86400) -> tuple[Column, Column]:
    """Alert kind and priority by precedence; null where all is well."""
    stale = last_success.isNull() | (F.unix_micros(now) - F.unix_micros(last_success) > stale_s * 1_000_000)
    kind = F.when(health.isNull(), "UNKNOWN").when(health == "FAILED", "FAILED").when(health == "DEGRADED", "DEGRADED").when(stale, "STALE")
    return kind, F.when(kind == "UNKNOWN", 70).when(kind == "FAILED", 80).when(kind.isNotNull(), 60)


def disk_level(used_pct: Column) -> Column:
    return F.when(used_pct >= 85, "critical").when(used_pct >= 70, "warning").otherwise("ok")


def state_at(events: DataFrame, current: DataFrame, key: str, cutoff: Column) -> DataFrame:
    """A field as of the cutoff: the first later event's old value, else the last earlier one's new value,
    else the current value. events: key, at, event_id, old_value, new_value; current: key, value."""
    turn = F.struct("at", "event_id")
    sides = events.groupBy(key).agg(
        F.min_by(F.struct("old_value"), F.when(F.col("at") > cutoff, turn)).alias("later"),
        F.max_by(F.struct("new_value"), F.when(F.col("at") <= cutoff, turn)).alias("earlier"),
    )
    out = current.join(sides, key, "left")
    value = F.when(F.col("later").isNotNull(), F.col("later.old_value")).when(F.col("earlier").isNotNull(), F.col("earlier.new_value")).otherwise(F.col("value"))
    return out.select(key, value.alias("value"))


def timeline(parts: list[DataFrame]) -> DataFrame:
    """Rows of (key, at, kind, ident, value) of several sources in one."""
    return reduce(lambda a, b: a.unionByName(b), parts)


# The modules of an analysis.
MODULES = ["features", "matching", "comparable", "valuation", "liquidity", "fast_sale", "llm", "seller", "risk", "deal", "opportunity"]


def initial_states(properties: DataFrame, latest: dict[str, DataFrame]) -> DataFrame:
    """A state row for each property: <module>_status from the latest row of each module, NOT_RUN without one.
    latest: by module, (property_id, done_at, input_at, status)."""
    if unknown := set(latest) - set(MODULES):
        raise ValueError(f"no such modules: {sorted(unknown)}")
    out = properties.select("property_id")
    for m in MODULES:
        if m in latest:
            row = latest[m].select("property_id", module_status(F.col("done_at"), F.col("input_at"), F.col("status")).alias(f"{m}_status"))
            out = out.join(row, "property_id", "left")
        else:
            out = out.withColumn(f"{m}_status", F.lit(None).cast("string"))
    empty = {f"{m}_status": F.coalesce(f"{m}_status", F.lit("NOT_RUN")) for m in MODULES}
    return out.withColumns(empty | {c: F.lit(None).cast("timestamp") for c in ("started_at", "completed_at", "updated_at")} | {"last_error": F.lit(None).cast("string")})


def marked(states: DataFrame, marks: DataFrame, kind: str, at: Column) -> DataFrame:
    """states after marks (property_id, module, status, error): kind STALE and PENDING set their own name, SUCCESS
    each mark's status. PENDING notes the start; SUCCESS the end, and clears the last error."""
    if kind not in ("STALE", "PENDING", "SUCCESS"):
        raise ValueError("a mark is STALE, PENDING or SUCCESS")
    given = F.lit(kind) if kind != "SUCCESS" else F.coalesce("status", F.lit("SUCCESS"))
    each = marks.filter(F.col("module").isin(MODULES)).groupBy("property_id").agg(
        *(F.max(F.when(F.col("module") == m, given)).alias(f"_{m}") for m in MODULES), F.max("error").alias("_error"), F.lit(True).alias("_hit"),
    )
    both = states.join(each, "property_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    out = {f"{m}_status": F.coalesce(f"_{m}", f"{m}_status") for m in MODULES} | {"updated_at": F.when(hit, at).otherwise(F.col("updated_at"))}
    if kind == "STALE":
        out["last_error"] = F.coalesce("_error", "last_error")
    elif kind == "PENDING":
        out["started_at"] = F.when(hit, at).otherwise(F.col("started_at"))
    else:
        out |= {"completed_at": F.when(hit, at).otherwise(F.col("completed_at")), "last_error": F.when(~hit, F.col("last_error"))}
    return both.withColumns(out).drop(*(f"_{m}" for m in MODULES), "_error", "_hit")


def unknown_modules(marks: DataFrame) -> DataFrame:
    """Marks of modules that do not exist, which marked() leaves out."""
    return marks.filter(~F.col("module").isin(MODULES))


def modules_with(states: DataFrame, status: str) -> DataFrame:
    """One row: in how many states any of the eleven modules has this status."""
    return states.agg(F.count_if(reduce(lambda a, b: a | b, (F.col(f"{m}_status") == status for m in MODULES))).alias("n"))


def with_discovered(history: DataFrame, listings: DataFrame) -> DataFrame:
    """A history (key, at, kind, ident, value) with a DISCOVERED entry at first_seen for every listing that has
    none. listings: key, first_seen, listing_id."""
    told = history.filter("kind = 'DISCOVERED'").select("key").distinct()
    made = listings.filter("first_seen is not null").join(told, "key", "left_anti")
    rows = made.select("key", F.col("first_seen").alias("at"), F.lit("DISCOVERED").alias("kind"), F.col("listing_id").cast("string").alias("ident"), F.lit(None).cast("string").alias("value"))
    return history.unionByName(rows)


def relist_sessions(listings: DataFrame, key: str, gap_days: int = 30) -> DataFrame:
    """(key, session, started_at, ended_at, listings): a property's time on the market in sessions, which end
    where no listing of it was seen for over gap_days."""
    w = Window.partitionBy(key).orderBy("first_seen", "last_seen", "listing_id")
    reach = F.max("last_seen").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.unix_micros("first_seen") - F.unix_micros(reach)) > gap_days * 86_400_000_000
    numbered = listings.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("session", F.sum("_new").over(w))
    return numbered.groupBy(key, "session").agg(F.min("first_seen").alias("started_at"), F.max("last_seen").alias("ended_at"), F.count("*").alias("listings"))
