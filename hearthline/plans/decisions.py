"""Queries of deal economics, decisions, alerts, watch rules, workflow and back-tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.operators import deals, opportunity, sellers, workflow
from hearthline.plans.registry import cents, load, query
from hearthline.plans.relational import STEPS, price_steps

PRICE = "CAST(round(o_totalprice * 100) AS BIGINT)"


@query(f"""WITH d AS (SELECT o_orderkey, {PRICE} AS p, {PRICE} // 20 AS reno, o_orderkey % 400 AS days FROM orders),
s AS (SELECT *, 'DOWNSIDE' AS scenario, 120 AS rp, 125 AS dp, p + p // 10 AS x FROM d UNION ALL SELECT *, 'BASE', 100, 100, p + p // 4 FROM d UNION ALL SELECT *, 'UPSIDE', 90, 75, p + p // 2 FROM d),
c AS (SELECT *, (reno * rp + 50) // 100 AS r, (days * dp + 50) // 100 AS dd, (2 * p * 250 + 10000) // 20000 AS taxes, (2 * x * 300 + 10000) // 20000 AS sale FROM s)
SELECT o_orderkey, scenario, CAST(p + r + 500000 + taxes + 1000 * dd + 100000 AS BIGINT) AS basis_cents, CAST(x - sale AS BIGINT) AS net_cents,
CAST(x - sale - (p + r + 500000 + taxes + 1000 * dd + 100000) AS BIGINT) AS profit_cents, CAST(dd AS BIGINT) AS days FROM c""")
def deal_scenarios(spark: SparkSession, d: str) -> DataFrame:
    (o,) = load(spark, d, "orders")
    price = cents("o_totalprice")
    base = o.select("o_orderkey", price.alias("pc"), (F.col("o_orderkey") % 400).alias("days"))
    base = base.selectExpr("o_orderkey", "days", "pc AS price", "pc div 20 AS renovation", "pc + pc div 10 AS exit_low", "pc + pc div 4 AS exit_base", "pc + pc div 2 AS exit_high")
    rules = {"notary": {"fixed": 5000}, "taxes": {"price_pct": "2.5"}, "sale": {"exit_pct": 3}, "holding": {"per_day": 10}}
    each = deals.scenario_rows(base, cents=True)
    e = deals.economics_cents(F.col("price"), F.col("exit_value"), F.col("scenario_renovation"), F.col("scenario_days"), F.lit(100_000), rules)
    return each.select("o_orderkey", "scenario", *(e[k].alias(f"{k}_cents") for k in ("basis", "net", "profit")), F.col("scenario_days").cast("long").alias("days"))


@query(f"""WITH d AS (SELECT o_orderkey, {PRICE} AS x, 500000 + o_orderkey % 100000 AS fixed FROM orders), n AS (SELECT *, x - (2 * x * 300 + 10000) // 20000 AS net FROM d)
SELECT o_orderkey, CAST(greatest(0, least(x, net - fixed - 200000, net * 10 // 11 - fixed)) AS BIGINT) AS max_buy_cents FROM n""")
def max_buy_price(spark: SparkSession, d: str) -> DataFrame:
    (o,) = load(spark, d, "orders")
    base = o.select("o_orderkey", cents("o_totalprice").alias("x"), (500000 + F.col("o_orderkey") % 100000).alias("fixed")).withColumn("net", F.expr("x - (2 * x * 300 + 10000) div 20000"))
    most = deals.max_buy_linear(F.col("x"), F.col("net"), F.col("fixed"), [], F.lit(200000), F.lit(100000))
    return base.select("o_orderkey", most.alias("max_buy_cents"))


DECIDED = f"""WITH d AS (SELECT o_orderkey, o_custkey, o_orderdate, {PRICE} // 100 - 100000 AS profit, {PRICE} // 200 - 60000 AS down, o_orderkey % 30 AS roi, o_orderkey % 25 AS neg, o_orderkey % 101 AS total, o_orderkey % 3 AS sig, o_orderkey % 11 AS g, o_orderkey % 13 AS miss, o_orderkey % 17 AS conf FROM orders),
a AS (SELECT *, CASE WHEN g = 0 THEN 'IGNORE' WHEN miss = 0 THEN 'REVIEW' WHEN conf = 0 THEN 'REVIEW' WHEN profit < 0 THEN 'IGNORE' WHEN down < 1000 OR roi < 5 THEN 'REVIEW' WHEN g = 1 THEN CASE WHEN neg <= 10 AND total >= 65 THEN 'CALL' ELSE 'REVIEW' END
WHEN neg <= 3 AND total >= 82 AND (sig > 0 OR profit >= 75000) THEN 'URGENT_CALL' WHEN neg <= 10 AND total >= 65 THEN 'CALL' WHEN neg <= 20 OR sig > 0 THEN 'WATCH' ELSE 'IGNORE' END AS action FROM d)"""


def decided(spark: SparkSession, d: str) -> DataFrame:
    (o,) = load(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col
    base = o.select("o_orderkey", "o_custkey", "o_orderdate", cents("o_totalprice").alias("pc"), (k % 30).alias("roi"), (k % 25).alias("neg"), (k % 101).alias("total"), (k % 3).alias("sig"), (k % 11).alias("g"), (k % 13).alias("miss"), (k % 17).alias("conf"))
    base = base.withColumn("profit", F.expr("pc div 100 - 100000")).withColumn("down", F.expr("pc div 200 - 60000"))
    economic = opportunity.issues([("NEGATIVE_EXPECTED_PROFIT", c("profit") < 0), ("DOWNSIDE_PROFIT_BELOW_MIN", c("down") < 1000), ("ROI_BELOW_MIN", c("roi") < 5)])
    gate = F.when(c("g") == 0, "BLOCK").when(c("g") == 1, "VERIFY").otherwise("PASS")
    act = opportunity.action(gate, opportunity.issues([("MISSING", c("miss") == 0)]), opportunity.issues([("LOW_CONFIDENCE", c("conf") == 0)]), economic, c("neg") / 100, c("total"), c("sig"), c("profit") >= 75000)
    return base.withColumn("economic", economic).withColumn("action", act)


@query(DECIDED + """ SELECT o_orderkey, action, CASE action WHEN 'URGENT_CALL' THEN 100 WHEN 'CALL' THEN 80 WHEN 'REVIEW' THEN 50 WHEN 'WATCH' THEN 30 ELSE 0 END AS priority,
concat_ws(',', CASE WHEN profit < 0 THEN 'NEGATIVE_EXPECTED_PROFIT' END, CASE WHEN down < 1000 THEN 'DOWNSIDE_PROFIT_BELOW_MIN' END, CASE WHEN roi < 5 THEN 'ROI_BELOW_MIN' END) AS reasons,
CAST(greatest(0, 2 * (greatest(profit, 0) + 2 * greatest(down, 0) + 1000 * roi) - neg * 1000) AS BIGINT) AS ranking_x2 FROM a""")
def opportunity_decision(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rank = opportunity.ranking(c("profit"), c("down"), c("roi") / 100, F.lit(0), c("neg") * 1000)
    return decided(spark, d).select("o_orderkey", "action", opportunity.priority(c("action")).alias("priority"), F.array_join("economic", ",").alias("reasons"), F.round(2 * rank).cast("long").alias("ranking_x2"))


@query(DECIDED + """ SELECT concat(o_custkey, ':', action) AS dedupe_key, CASE action WHEN 'CALL' THEN 80 ELSE 100 END AS priority FROM a WHERE action IN ('CALL', 'URGENT_CALL') AND o_custkey % 10 > 0 GROUP BY ALL""")
def alert_dedupe(spark: SparkSession, d: str) -> DataFrame:
    keyed = decided(spark, d).select("action", "o_custkey", F.concat(F.col("o_custkey").cast("string"), F.lit(":"), "action").alias("dedupe_key"))
    sent = keyed.filter("o_custkey % 10 = 0").select("dedupe_key").distinct()
    return opportunity.new_alerts(keyed, sent).select("dedupe_key", "priority")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(ts AS TIMESTAMP) AS ts FROM events WHERE event_type = 'error'), f AS (SELECT user_id, event_id, ts FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1
UNION ALL SELECT * FROM (SELECT e.user_id, e.event_id, e.ts FROM f JOIN e ON e.user_id = f.user_id AND e.ts >= f.ts + INTERVAL 6 HOUR QUALIFY row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) = 1)) SELECT event_id, user_id FROM f""")
def alert_cooldown(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of a user at least six hours apart from the last one that was sent."""
    (ev,) = load(spark, d, "events")
    alerts = ev.filter("event_type = 'error'").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return opportunity.cooled(alerts, ["user_id"], "ts", "event_id").select("event_id", "user_id")


@query(f"""WITH s AS ({STEPS}) SELECT user_id, event_id, 'PRICE_BELOW' AS rule_type FROM s WHERE user_id % 2 = 0 AND new_price <= 2000 AND (old_price IS NULL OR old_price > 2000)
UNION ALL SELECT user_id, event_id, 'PRICE_DROP_PERCENT' FROM s WHERE user_id % 2 = 1 AND user_id % 3 > 0 AND old_price > 0 AND (old_price - new_price) * 100 >= 30 * old_price""")
def watch_triggers(spark: SparkSession, d: str) -> DataFrame:
    (ev,) = load(spark, d, "events")
    steps = price_steps(ev).withColumnRenamed("user_id", "property_id")
    users = ev.select(F.col("user_id").alias("property_id")).distinct()
    even = F.col("property_id") % 2 == 0
    rules = users.select("property_id", F.col("property_id").alias("rule_id"), F.when(even, "PRICE_BELOW").otherwise("PRICE_DROP_PERCENT").alias("rule_type"), F.when(even, 2000).otherwise(30).alias("threshold"), (even | (F.col("property_id") % 3 > 0)).alias("is_active"))
    return workflow.triggers(rules, steps).select(F.col("property_id").alias("user_id"), "event_id", "rule_type")


@query("""SELECT o_custkey, o_orderkey AS rule_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1 AND o_orderstatus <> 'F'""")
def watch_active_rule(spark: SparkSession, d: str) -> DataFrame:
    (o,) = load(spark, d, "orders")
    rules = o.select(F.col("o_custkey").alias("property_id"), F.col("o_orderkey").alias("rule_id"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") != "F").alias("is_active"))
    return workflow.active_rules(rules).select(F.col("property_id").alias("o_custkey"), "rule_id")


@query("""WITH m AS (SELECT unnest([{'t': 'click', 'm': 'deal'}, {'t': 'click', 'm': 'opportunity'}, {'t': 'view', 'm': 'llm'}, {'t': 'view', 'm': 'seller'}, {'t': 'view', 'm': 'risk'}, {'t': 'view', 'm': 'deal'}, {'t': 'view', 'm': 'opportunity'}, {'t': 'purchase', 'm': 'seller'}, {'t': 'purchase', 'm': 'risk'}, {'t': 'purchase', 'm': 'deal'}, {'t': 'purchase', 'm': 'opportunity'}]) AS x)
SELECT user_id, x.m AS module, max(ts) AS stale_since, count(*) AS events FROM events JOIN m ON event_type = x.t GROUP BY ALL""")
def invalidation_map(spark: SparkSession, d: str) -> DataFrame:
    (ev,) = load(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "PRICE_CHANGED").when(F.col("event_type") == "view", "DESCRIPTION_CHANGED").when(F.col("event_type") == "purchase", "SELLER_CHANGED")
    stale = ev.select("user_id", "ts", F.explode(workflow.stale_modules(kind)).alias("module"))
    return stale.groupBy("user_id", "module").agg(F.max("ts").alias("stale_since"), F.count("*").alias("events"))


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 'REVIEWED' WHEN 'click' THEN 'CALLED' WHEN 'signup' THEN 'VISITED' WHEN 'purchase' THEN 'WON' ELSE 'SKIPPED' END AS status FROM events),
r AS (SELECT *, CASE status WHEN 'REVIEWED' THEN 10 WHEN 'CALLED' THEN 20 WHEN 'VISITED' THEN 40 ELSE 80 END AS rank FROM e)
SELECT user_id, status, rank, count(*) OVER (PARTITION BY user_id) AS steps FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank DESC, ts, event_id) = 1""")
def pipeline_fold(spark: SparkSession, d: str) -> DataFrame:
    (ev,) = load(spark, d, "events")
    kind = F.col("event_type")
    status = F.when(kind == "view", "REVIEWED").when(kind == "click", "CALLED").when(kind == "signup", "VISITED").when(kind == "purchase", "WON").otherwise("SKIPPED")
    steps = ev.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id", status.alias("status"))
    return workflow.pipeline_state(steps, "user_id", ["t", "event_id"])


@query("""WITH l AS (SELECT CASE WHEN doc_id % 7 > 0 THEN quality = 1 END AS positive, toxic = 0 AS called FROM labels),
c AS (SELECT CASE WHEN positive IS NULL THEN 'UNKNOWN' WHEN positive AND called THEN 'TRUE_POSITIVE' WHEN positive THEN 'FALSE_NEGATIVE' WHEN called THEN 'FALSE_POSITIVE' ELSE 'TRUE_NEGATIVE' END AS class FROM l)
SELECT count(*) FILTER (class = 'TRUE_POSITIVE') AS tp, count(*) FILTER (class = 'FALSE_POSITIVE') AS fp, count(*) FILTER (class = 'FALSE_NEGATIVE') AS fn, count(*) FILTER (class = 'TRUE_NEGATIVE') AS tn,
count(*) FILTER (class = 'UNKNOWN') AS unknown, CAST(count(*) FILTER (class = 'TRUE_POSITIVE') * 1000000 // nullif(count(*) FILTER (class IN ('TRUE_POSITIVE', 'FALSE_POSITIVE')), 0) AS BIGINT) AS precision_ppm FROM c""")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    (labels,) = load(spark, d, "labels")
    positive = F.when(F.col("doc_id") % 7 > 0, F.col("quality") == 1)
    told = labels.select(workflow.classified(positive, F.col("toxic") == 0).alias("class"))
    n = lambda name: F.count_if(F.col("class") == name)
    out = told.agg(n("TRUE_POSITIVE").alias("tp"), n("FALSE_POSITIVE").alias("fp"), n("FALSE_NEGATIVE").alias("fn"), n("TRUE_NEGATIVE").alias("tn"), n("UNKNOWN").alias("unknown"))
    return out.withColumn("precision_ppm", F.floor(F.try_divide(F.col("tp") * 1000000, F.col("tp") + F.col("fp"))).cast("long"))


@query(f"""WITH s AS ({STEPS}), l AS (SELECT user_id, arg_min(old_price, (seen, event_id)) AS v, count(*) AS n FROM s WHERE seen > TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1),
e AS (SELECT user_id, arg_max(new_price, (seen, event_id)) AS v FROM s WHERE seen <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1), c AS (SELECT DISTINCT user_id FROM events)
SELECT c.user_id, CASE WHEN l.n > 0 THEN l.v WHEN e.user_id IS NOT NULL THEN e.v ELSE -1 END AS value FROM c LEFT JOIN l ON c.user_id = l.user_id LEFT JOIN e ON c.user_id = e.user_id""")
def snapshot_asof(spark: SparkSession, d: str) -> DataFrame:
    (ev,) = load(spark, d, "events")
    events = price_steps(ev).select("user_id", "at", "event_id", F.col("old_price").alias("old_value"), F.col("new_price").alias("new_value"))
    current = ev.select("user_id").distinct().withColumn("value", F.lit(-1).cast("long"))
    return workflow.state_at(events, current, "user_id", F.lit("2024-01-15 12:00:00").cast("timestamp"))


@query(f"""WITH f AS (SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS deal, min(o_orderdate) AS opened FROM orders GROUP BY 1),
x AS (SELECT o_custkey, max({PRICE}) AS sold, max(o_orderdate) AS closed, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '1999-01-01' GROUP BY 1)
SELECT f.o_custkey, deal, CASE WHEN x.n IS NULL THEN 'OPEN' WHEN x.n = 1 THEN 'UNKNOWN' ELSE 'MEASURED' END AS status, CASE WHEN x.n > 1 THEN CAST(greatest(floor((epoch_us(closed) - epoch_us(opened)) / 86400000000), 0) AS BIGINT) END AS days, CASE WHEN x.n > 1 THEN sold END AS sold_cents
FROM f LEFT JOIN x ON f.o_custkey = x.o_custkey""")
def shadow_outcomes(spark: SparkSession, d: str) -> DataFrame:
    from hearthline.functions.numbers import elapsed_days

    (o,) = load(spark, d, "orders")
    first = o.groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("f")).select("o_custkey", F.col("f.o_orderkey").alias("deal"), F.col("f.o_orderdate").alias("opened"))
    known = o.filter((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") <= F.lit("1999-01-01").cast("timestamp")))
    outcome = known.groupBy("o_custkey").agg(F.max(cents("o_totalprice")).alias("sold"), F.max("o_orderdate").alias("closed"), F.count("*").alias("n"))
    status = F.when(F.col("n").isNull(), "OPEN").when(F.col("n") == 1, "UNKNOWN").otherwise("MEASURED")
    both = first.join(outcome, "o_custkey", "left").withColumn("status", status)
    measured = lambda x: F.when(F.col("status") == "MEASURED", x)
    return both.select("o_custkey", "deal", "status", measured(elapsed_days(F.col("closed"), F.col("opened")).cast("long")).alias("days"), measured(F.col("sold")).alias("sold_cents"))


@query("""WITH h AS (SELECT conv_id, turn, sha256(text) AS input_hash FROM conversations WHERE role = 'user') SELECT conv_id, turn, min(conv_id * 1000 + turn) OVER (PARTITION BY input_hash) AS cached_from,
min(conv_id * 1000 + turn) OVER (PARTITION BY input_hash) < conv_id * 1000 + turn AS hit FROM h""")
def llm_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    (conv,) = load(spark, d, "conversations")
    asked = conv.filter("role = 'user'").select("conv_id", "turn", F.sha2(F.col("text").cast("binary"), 256).alias("input_hash"))
    cache = asked.groupBy("input_hash").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("cached_from"))
    return asked.join(cache, "input_hash").select("conv_id", "turn", "cached_from", (F.col("cached_from") < F.col("conv_id") * 1000 + F.col("turn")).alias("hit"))


@query("""WITH a AS (SELECT o_orderkey, o_orderkey % 101 AS s1, o_orderkey % 89 AS s2, o_orderkey % 4 AS k FROM orders), n AS (SELECT *, s1 * 35 + CASE WHEN k > 0 THEN s2 * 30 ELSE 0 END AS num, 35 + CASE WHEN k > 0 THEN 30 ELSE 0 END AS w FROM a)
SELECT o_orderkey, CAST(num * 1000 // w AS BIGINT) AS score, CASE WHEN num >= 70 * w THEN 'HIGH' WHEN num >= 45 * w THEN 'MEDIUM' ELSE 'LOW' END AS level FROM n""")
def component_confidence(spark: SparkSession, d: str) -> DataFrame:
    (o,) = load(spark, d, "orders")
    k = F.col("o_orderkey")
    parts = sellers.components([("a", 35, k % 101, F.lit(60)), ("b", 30, F.when(k % 4 > 0, k % 89), F.lit(70))])
    score, _ = sellers.weighted(F.col("parts"))
    out = o.select("o_orderkey", parts.alias("parts")).select("o_orderkey", score.alias("s"))
    return out.select("o_orderkey", F.floor(F.col("s") * 1000 + 1e-6).cast("long").alias("score"), sellers.level(F.col("s")).alias("level"))


@query("""SELECT o_orderkey, 'FAILED' AS status FROM orders WHERE o_orderstatus = 'P' AND epoch_us(TIMESTAMP '2000-01-01') - epoch_us(o_orderdate) > 7200000000""")
def stale_jobs_retention(spark: SparkSession, d: str) -> DataFrame:
    (o,) = load(spark, d, "orders")
    jobs = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("DONE").alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"))
    return workflow.stale_jobs(jobs, F.lit("2000-01-01").cast("timestamp")).select("o_orderkey", "status")


@query("""WITH h AS (SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'DEGRADED' WHEN 2 THEN 'HEALTHY' END AS health, max(ts) AS last FROM events WHERE event_type = 'purchase' GROUP BY 1),
k AS (SELECT user_id, CASE WHEN health IS NULL THEN 'UNKNOWN' WHEN health IN ('FAILED', 'DEGRADED') THEN health WHEN epoch_us(TIMESTAMP '2024-01-30') - epoch_us(last) > 86400 * 1000000::BIGINT THEN 'STALE' END AS alert FROM h)
SELECT alert, CASE alert WHEN 'UNKNOWN' THEN 70 WHEN 'FAILED' THEN 80 ELSE CASE WHEN alert IS NOT NULL THEN 60 END END AS priority, count(*) AS sources FROM k GROUP BY ALL""")
def source_health(spark: SparkSession, d: str) -> DataFrame:
    (ev,) = load(spark, d, "events")
    k = F.col("user_id") % 4
    health = F.when(k == 0, "FAILED").when(k == 1, "DEGRADED").when(k == 2, "HEALTHY")
    last = ev.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("last"))
    alert, priority = workflow.source_alert(health, F.col("last"), F.lit("2024-01-30").cast("timestamp"))
    return last.select(alert.alias("alert"), priority.alias("priority")).groupBy("alert", "priority").agg(F.count("*").alias("sources"))
