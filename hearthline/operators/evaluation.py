"""Back-tests over a table of cutoffs: what was known at each, what came of it, and how good the calls were."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.functions.numbers import nearest
from hearthline.operators.snapshots import is_positive
from hearthline.operators.workflow import classified

# Actions that raise an alert.
ALERTABLE = ("CALL", "URGENT_CALL")
#: Cutoffs of one run are a list that every task holds.
MOST_CUTOFFS = 10_000


def latest_at_cutoffs(df: DataFrame, keys: list[str], seen_at: Column, order: list[str], cutoffs: list, name: str) -> DataFrame:
    """(keys, cutoff, name): for each cutoff the last row, by order, of those that could be seen by then (seen_at no later
    than the cutoff), as a struct of the columns that are no keys. Nothing later is looked at.

    A row counts from the first cutoff that sees it. The best row of each key and such cutoff is a struct maximum, taken
    before the shuffle, so that a key of any number of rows brings one a cutoff; these are then carried on to the later
    cutoffs."""
    if len(cutoffs) > MOST_CUTOFFS:
        raise ValueError(f"at most {MOST_CUTOFFS} cutoffs")
    points = F.array(*(F.lit(c).cast("timestamp") for c in sorted(set(cutoffs))))
    rest = [c for c in df.columns if c not in {*keys, *order}]
    first = F.array_min(F.filter(points, lambda c: c >= F.col("_seen")))
    dated = df.withColumn("_seen", seen_at).withColumn("_first", first).filter("_first is not null")
    best = dated.groupBy(*keys, "_first").agg(F.max(F.struct(*order, *rest)).alias(name))
    carried = best.withColumn("cutoff", F.explode(F.filter(points, lambda c: c >= F.col("_first"))))
    return carried.groupBy(*keys, "cutoff").agg(F.max(name).alias(name))


def asof_join(asks: DataFrame, history: DataFrame, keys: list[str], ask_at: str, at: str, order: list[str], name: str, chunk_s: int = 30 * 86_400) -> DataFrame:
    """asks with the last row of history (by at, then order) of the same keys and no later than the ask's own time, as a
    struct `name`, null where there is none.

    Both are laid on one line per key and chunk of time, so that a key's history is split over tasks; each chunk begins
    with the last row of those before it, a struct maximum per chunk that a running maximum carries on."""
    chunk = lambda c: F.floor(F.unix_seconds(F.col(c)) / chunk_s)
    rest = [c for c in history.columns if c not in {*keys, at, *order}]
    rows = history.filter(F.col(at).isNotNull()).select(*keys, chunk(at).alias("_chunk"), F.col(at).alias("_at"), F.struct(at, *order, *rest).alias(name))
    ends = rows.groupBy(*keys, "_chunk").agg(F.max(name).alias("_end"))
    asked = asks.filter(F.col(ask_at).isNotNull()).withColumn("_chunk", chunk(ask_at))
    # Chunks without history of their own are asked about too: the running maximum goes over both.
    places = ends.unionByName(asked.select(*keys, "_chunk", F.lit(None).cast(rows.schema[name].dataType).alias("_end"))).groupBy(*keys, "_chunk").agg(F.max("_end").alias("_end"))
    before = places.withColumn("_before", F.max("_end").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))).select(*keys, "_chunk", "_before")
    line = rows.withColumn("_kind", F.lit(0)).unionByName(asked.select(*keys, "_chunk", F.col(ask_at).alias("_at"), F.struct(*asks.columns).alias("_ask")).withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_chunk").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = line.withColumn(name, F.max(name).over(w)).filter("_kind = 1").join(before, [*keys, "_chunk"], "left")
    found = within.select("_ask.*", F.coalesce(name, "_before").alias(name))
    return found.unionByName(asks.filter(F.col(ask_at).isNull()), allowMissingColumns=True)


def evaluation_items(cutoffs: list[tuple], opportunities: DataFrame, deals: DataFrame, valuations: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per cutoff and property that had an opportunity by then, or an outcome by the time of measuring.

    cutoffs: (cutoff, measured_at), measured_at no earlier. Tables have property_id, as_of, created_at and id;
    opportunities action and deal_id, deals max_buy, downside_profit and cost_basis, valuations fair_value, outcomes
    outcome_date, outcome_type and sale_price. An opportunity's own deal counts if it was there by the cutoff and is the
    property's, else the latest deal of that time. Outcomes are known once they happened and were recorded."""
    if late := [c for c, m in cutoffs if m < c]:
        raise ValueError(f"measured before the cutoff: {late}")
    c, points, measured = F.col, [p for p, _ in cutoffs], [m for _, m in cutoffs]
    latest = lambda df, name: latest_at_cutoffs(df, ["property_id"], c("as_of"), ["as_of", "created_at", "id"], points, name)
    pair = F.create_map(*(F.lit(x).cast("timestamp") for p, m in cutoffs for x in (p, m)))
    known = latest_at_cutoffs(outcomes, ["property_id"], F.greatest("outcome_date", "created_at"), ["outcome_date", "created_at", "id"], measured, "outcome")
    seen = known.withColumnRenamed("cutoff", "measured_at")
    times = F.explode(F.map_entries(pair)).alias("t")
    by_cutoff = outcomes.sparkSession.range(1).select(times).select(c("t.key").alias("cutoff"), c("t.value").alias("measured_at"))
    outcome = seen.join(F.broadcast(by_cutoff), "measured_at").select("property_id", "cutoff", "outcome")
    both = latest(opportunities, "opportunity").join(outcome, ["property_id", "cutoff"], "full")
    own = deals.select(c("id").alias("deal_id"), c("property_id"), F.struct(*[x for x in deals.columns if x != "property_id"]).alias("own"))
    linked = both.withColumn("deal_id", c("opportunity.deal_id")).join(own, ["deal_id", "property_id"], "left")
    all_ = linked.join(latest(deals, "deal"), ["property_id", "cutoff"], "left").join(latest(valuations, "valuation"), ["property_id", "cutoff"], "left")
    of = lambda f: F.when(c("own.as_of") <= c("cutoff"), c(f"own.{f}")).otherwise(c(f"deal.{f}"))
    out = all_.select(
        "property_id", "cutoff", c("opportunity.action").alias("action"), c("outcome.outcome_type").alias("outcome_type"), c("outcome.sale_price").alias("sale_price"),
        of("id").alias("deal_id"), of("max_buy").alias("max_buy"), of("downside_profit").alias("downside_profit"), c("deal.cost_basis").alias("cost_basis"), c("valuation.fair_value").alias("fair_value"),
    )
    called = F.coalesce(c("action").isin(*ALERTABLE), F.lit(False))
    return out.withColumn("called", called).withColumn("classification", classified(is_positive(c("outcome_type"), c("sale_price"), c("max_buy")), called))


def evaluation_metrics(items: DataFrame) -> DataFrame:
    """Counts and rates per cutoff: precision and call-worthy rate in ten thousandths, money as in the items."""
    c = F.col
    n = lambda condition, name: F.count_if(condition).alias(name)
    counts = items.groupBy("cutoff").agg(
        F.count("*").alias("total_items"), n(c("called"), "alertable_recommendations"), n(c("classification") != "UNKNOWN", "measured_outcomes"),
        *(n(c("classification") == k, k.lower()) for k in ("TRUE_POSITIVE", "FALSE_POSITIVE", "FALSE_NEGATIVE", "TRUE_NEGATIVE", "UNKNOWN")),
        n(c("called") & (c("downside_profit") < 0), "downside_failures"), n(c("classification") == "FALSE_NEGATIVE", "missed_opportunities"),
        F.sum(F.abs(c("fair_value") - c("sale_price"))).alias("_error"), F.count(c("fair_value") - c("sale_price")).alias("_errors"), F.sum(c("sale_price") - c("cost_basis")).alias("simulated_profitability_total"),
    )
    return counts.withColumns({
        "alert_precision_e4": nearest(10_000 * c("true_positive"), c("true_positive") + c("false_positive")),
        "call_worthy_rate_e4": nearest(10_000 * c("alertable_recommendations"), c("total_items")), "valuation_mae": nearest(c("_error"), c("_errors")),
    }).drop("_error", "_errors")
