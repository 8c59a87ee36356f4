"""Back-tests: orders stand for assessments, deals, valuations and outcomes of the customers' properties."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.operators import evaluation
from hearthline.plans.registry import load, query

#: Ten half-year cutoffs, measured 200 days later.
CUTOFFS = [(at, at + datetime.timedelta(days=200)) for at in (datetime.datetime(1996 + k // 2, 1 + 6 * (k % 2), 1) for k in range(10))]

ACTION = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'URGENT_CALL' WHEN '2' THEN 'CALL' WHEN '3' THEN 'WATCH' ELSE 'SKIP' END"
OUTCOME = "CASE o_orderkey % 8 WHEN 0 THEN 'BOUGHT_BY_USER' WHEN 1 THEN 'LOST_TO_OTHER_BUYER' WHEN 2 THEN 'SALE_CANCELLED' WHEN 3 THEN 'STILL_ACTIVE' WHEN 4 THEN 'OTHER' WHEN 5 THEN 'LIKELY_SOLD' ELSE 'CONFIRMED_SOLD' END"
DEAL_ID = "CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey + o_orderkey % 2 END"
CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
SALE = "CASE WHEN o_orderkey % 11 > 0 THEN {p} - o_orderkey % 5 * 1000000 END"


def _tables(spark: SparkSession, d: str) -> list[DataFrame]:
    (orders,) = load(spark, d, "orders")
    base = orders.select("*", F.col("o_custkey").cast("long").alias("property_id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.round(F.col("o_totalprice") * 100).cast("long").alias("price"))
    days = lambda n: F.expr(f"at + make_dt_interval(CAST({n} AS INT))")
    k = F.col("o_orderkey").cast("long").alias("id")
    return [
        base.select("property_id", F.col("at").alias("as_of"), F.col("at").alias("created_at"), k, F.expr(ACTION).alias("action"), F.expr(DEAL_ID).cast("long").alias("deal_id")),
        base.select("property_id", days("o_orderkey % 3").alias("as_of"), F.col("at").alias("created_at"), k, (F.col("price") - F.col("price") % 10).alias("max_buy"), ((F.col("o_orderkey") % 7 - 2) * 1000).cast("long").alias("downside_profit"), (F.col("price") - F.col("price") % 7).alias("cost_basis")),
        base.filter("o_orderstatus <> 'F'").select("property_id", F.col("at").alias("as_of"), F.col("at").alias("created_at"), k, F.col("price").alias("fair_value")),
        base.filter("o_orderstatus = 'F'").select("property_id", days("30").alias("outcome_date"), days("o_orderkey % 90").alias("created_at"), k, F.expr(OUTCOME).alias("outcome_type"), F.expr(SALE.format(p="price")).cast("long").alias("sale_price")),
    ]


POINTS = ", ".join(f"(TIMESTAMP '{p}', TIMESTAMP '{m}')" for p, m in CUTOFFS)
ITEMS = f"""c AS (SELECT * FROM (VALUES {POINTS}) AS v(cutoff, measured_at)),
b AS (SELECT *, o_custkey AS property_id, CAST(o_orderdate AS TIMESTAMP) AS seen, o_orderkey AS id, {CENTS} AS price FROM orders),
op AS (SELECT property_id, cutoff, id, {ACTION} AS action, {DEAL_ID} AS deal_id FROM b, c WHERE seen <= cutoff QUALIFY row_number() OVER (PARTITION BY property_id, cutoff ORDER BY seen DESC, id DESC) = 1),
de AS (SELECT property_id, id, seen, seen + to_days(CAST(o_orderkey % 3 AS INT)) AS as_of, price - price % 10 AS max_buy, (o_orderkey % 7 - 2) * 1000 AS downside, price - price % 7 AS cost FROM b),
dl AS (SELECT de.*, cutoff FROM de, c WHERE as_of <= cutoff QUALIFY row_number() OVER (PARTITION BY property_id, cutoff ORDER BY as_of DESC, seen DESC, id DESC) = 1),
va AS (SELECT property_id, cutoff, price AS fair FROM b, c WHERE o_orderstatus <> 'F' AND seen <= cutoff QUALIFY row_number() OVER (PARTITION BY property_id, cutoff ORDER BY seen DESC, id DESC) = 1),
oc AS (SELECT property_id, cutoff, {OUTCOME} AS outcome_type, {SALE.format(p="price")} AS sale FROM b, c WHERE o_orderstatus = 'F' AND seen + INTERVAL 30 DAY <= measured_at AND seen + to_days(CAST(o_orderkey % 90 AS INT)) <= measured_at
QUALIFY row_number() OVER (PARTITION BY property_id, cutoff ORDER BY seen DESC, o_orderkey % 90 DESC, id DESC) = 1),
it AS (SELECT property_id, cutoff, action, outcome_type, sale AS sale_price, coalesce(own.id, dl.id) AS deal_id, CASE WHEN own.id IS NOT NULL THEN own.max_buy ELSE dl.max_buy END AS max_buy, CASE WHEN own.id IS NOT NULL THEN own.downside ELSE dl.downside END AS downside_profit,
dl.cost AS cost_basis, fair AS fair_value, coalesce(action IN ('CALL', 'URGENT_CALL'), FALSE) AS called FROM op FULL JOIN oc USING (property_id, cutoff) LEFT JOIN de AS own ON own.id = op.deal_id AND own.property_id = op.property_id AND own.as_of <= op.cutoff LEFT JOIN dl USING (property_id, cutoff) LEFT JOIN va USING (property_id, cutoff)),
po AS (SELECT *, CASE WHEN outcome_type = 'BOUGHT_BY_USER' THEN TRUE WHEN outcome_type IN ('LOST_TO_OTHER_BUYER', 'SALE_CANCELLED') THEN FALSE WHEN outcome_type IN ('CONFIRMED_SOLD', 'LIKELY_SOLD') THEN sale_price <= max_buy END AS positive FROM it),
items AS (SELECT * EXCLUDE (positive), CASE WHEN positive IS NULL THEN 'UNKNOWN' WHEN positive AND called THEN 'TRUE_POSITIVE' WHEN positive THEN 'FALSE_NEGATIVE' WHEN called THEN 'FALSE_POSITIVE' ELSE 'TRUE_NEGATIVE' END AS classification FROM po)"""


def items(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.evaluation_items(CUTOFFS, *_tables(spark, d))


@query(f"WITH {ITEMS} SELECT * FROM items")
def evaluation_items(spark: SparkSession, d: str) -> DataFrame:
    """What was known of every property at each of ten cutoffs, and what came of it."""
    return items(spark, d)


@query(f"""WITH {ITEMS}, m AS (SELECT cutoff, count(*) AS total_items, count_if(called) AS alertable_recommendations, count_if(classification <> 'UNKNOWN') AS measured_outcomes, count_if(classification = 'TRUE_POSITIVE') AS true_positive, count_if(classification = 'FALSE_POSITIVE') AS false_positive,
count_if(classification = 'FALSE_NEGATIVE') AS false_negative, count_if(classification = 'TRUE_NEGATIVE') AS true_negative, count_if(classification = 'UNKNOWN') AS unknown, count_if(called AND downside_profit < 0) AS downside_failures, sum(abs(fair_value - sale_price)) AS e, count(fair_value - sale_price) AS n, CAST(sum(sale_price - cost_basis) AS BIGINT) AS simulated_profitability_total FROM items GROUP BY cutoff)
SELECT * EXCLUDE (e, n), false_negative AS missed_opportunities, CAST((20000 * true_positive + true_positive + false_positive) // nullif(2 * (true_positive + false_positive), 0) AS BIGINT) AS alert_precision_e4, CAST((20000 * alertable_recommendations + total_items) // (2 * total_items) AS BIGINT) AS call_worthy_rate_e4, CAST((2 * e + n) // nullif(2 * n, 0) AS BIGINT) AS valuation_mae FROM m""")
def evaluation_run(spark: SparkSession, d: str) -> DataFrame:
    """Precision, call-worthy rate, error of values, downside failures and missed ones, per cutoff."""
    return evaluation.evaluation_metrics(items(spark, d))


@query(f"""WITH e AS (SELECT user_id, event_id, CAST(ts AS TIMESTAMP) AS ts, event_type, CAST(round(value * 100) AS BIGINT) AS price FROM events), a AS (SELECT * FROM e WHERE event_type = 'purchase'), h AS (SELECT * FROM e WHERE event_type = 'view')
SELECT a.user_id, a.event_id, arg_max(h.event_id, (h.ts, h.event_id)) AS seen_event, arg_max(h.price, (h.ts, h.event_id)) AS seen_price FROM a LEFT JOIN h ON h.user_id = a.user_id AND h.ts <= a.ts GROUP BY ALL""")
def asof_own_times(spark: SparkSession, d: str) -> DataFrame:
    """For each purchase the user's last view before it: every ask has a time of its own."""
    (events,) = load(spark, d, "events")
    e = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.round(F.col("value") * 100).cast("long").alias("price"))
    asks = e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    views = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("seen_event"), F.col("price").alias("seen_price"))
    found = evaluation.asof_join(asks, views, ["user_id"], "ts", "seen", ["seen_event"], "last", chunk_s=3 * 86_400)
    return found.select("user_id", "event_id", F.col("last.seen_event").alias("seen_event"), F.col("last.seen_price").alias("seen_price"))
