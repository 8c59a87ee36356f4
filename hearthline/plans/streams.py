"""Streaming jobs run over the events table as a stream, compared with batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.operators.rows import shared_folder
from hearthline.plans.registry import cents, query
from hearthline.plans.relational import STEPS
from hearthline.streaming import jobs
from hearthline.streaming.current import CurrentListings, IncrementalAnalysis


def folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a file stream. A pattern, since a stream's plain path must be a folder."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("price", cents("value"))


def on_time(changes: DataFrame) -> DataFrame:
    return changes.filter("not late").drop("late")


@query(f"WITH s AS ({STEPS}) SELECT user_id, event_id, seen AS ts, old_price AS old_value, new_price AS new_value FROM s WHERE old_price <> new_price")
def stream_price_changes(spark: SparkSession, d: str) -> DataFrame:
    return on_time(jobs.run_available(jobs.price_changes(events(spark, d), "user_id", "ts", "event_id", "price"), folder(spark)))


@query(f"WITH s AS ({STEPS}) SELECT user_id, user_id AS rule_id, event_id FROM s WHERE old_price <> new_price AND new_price <= 2000 AND old_price > 2000")
def stream_watch_triggers(spark: SparkSession, d: str) -> DataFrame:
    """Every user has a rule; it meets each of the user's changes that crosses its threshold."""
    changes = jobs.run_available(jobs.price_changes(events(spark, d), "user_id", "ts", "event_id", "price"), at := folder(spark))
    again = on_time(spark.readStream.schema(changes.schema).parquet(f"{at}/rows"))
    users = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct()
    rules = users.select("user_id", F.col("user_id").alias("rule_id"), F.lit("PRICE_BELOW").alias("rule_type"), F.lit(2000).alias("threshold"), F.lit(True).alias("is_active"))
    return jobs.run_available(jobs.watch_triggers(again, rules, "user_id", "ts", "event_id"), folder(spark)).select("user_id", "rule_id", "event_id")


@query("""WITH e AS (SELECT event_type, date_trunc('day', CAST(ts AS TIMESTAMP)) AS day, CAST(ts AS TIMESTAMP) AS ts FROM events), w AS (SELECT event_type, day - to_days(CAST(k AS INT)) AS start FROM e, range(7) AS r(k))
SELECT start, event_type, count(*) AS n FROM w WHERE start + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM e) GROUP BY ALL""")
def stream_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Complete seven-day windows by event type; windows that the watermark has not passed are kept back."""
    return jobs.run_available(jobs.windowed_counts(events(spark, d), "ts", ["event_type"]), folder(spark))


@query("SELECT sha256(concat(event_type, ':', user_id)) AS content_hash FROM events GROUP BY 1")
def stream_distinct_records(spark: SparkSession, d: str) -> DataFrame:
    content = F.concat(F.col("event_type"), F.lit(":"), F.col("user_id").cast("string"))
    return jobs.run_available(jobs.distinct_records(events(spark, d), "ts", content, "400 days"), folder(spark)).select("content_hash")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(ts AS TIMESTAMP) AS ts FROM events WHERE event_type = 'error'), f AS (SELECT user_id, event_id, ts FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1
UNION ALL SELECT * FROM (SELECT e.user_id, e.event_id, e.ts FROM f JOIN e ON e.user_id = f.user_id AND e.ts >= f.ts + INTERVAL 6 HOUR QUALIFY row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) = 1)) SELECT * FROM f""")
def stream_cooled_alerts(spark: SparkSession, d: str) -> DataFrame:
    errors = events(spark, d).filter("event_type = 'error'")
    return on_time(jobs.run_available(jobs.cooled_alerts(errors, "user_id", "ts", "event_id"), folder(spark)))


@query("""WITH s AS (SELECT user_id, event_id, event_type IN ('view', 'click') AS seen, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)
SELECT user_id, event_id AS scan_id, CAST(sum(CASE WHEN seen THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, g ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS misses, CASE WHEN seen THEN 'ACTIVE' ELSE 'NOT_SEEN' END AS status FROM s""")
def stream_miss_counts(spark: SparkSession, d: str) -> DataFrame:
    scans = events(spark, d).select("user_id", F.col("event_id").alias("scan_id"), F.col("event_type").isin("view", "click").alias("seen"), "ts")
    return jobs.run_available(jobs.miss_counts(scans, "user_id", "ts"), folder(spark))


#: What comes in the second run: the later half of the time, and of the earlier one every fiftieth row, late.
SECOND = "(ts >= TIMESTAMP '2024-01-15 12:00:00' OR event_id % 50 = 0)"
ARRIVED = f"""e AS (SELECT user_id, event_id, CAST(ts AS TIMESTAMP) AS ts, CAST(round(value * 100) AS BIGINT) AS price, {SECOND.replace("ts >=", "CAST(ts AS TIMESTAMP) >=")} AS second FROM events),
f AS (SELECT user_id, max({{'a': ts, 'b': event_id}}) AS last FROM e WHERE NOT second GROUP BY 1), g AS (SELECT e.*, coalesce(second AND {{'a': ts, 'b': event_id}} <= last, FALSE) AS late FROM e LEFT JOIN f USING (user_id))"""


def two_runs(spark: SparkSession, d: str) -> CurrentListings:
    """The events arrive in two deliveries; the stream runs after each."""
    at = folder(spark)
    every = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), cents("value").alias("price"))
    listings = CurrentListings(spark, f"{at}/listings", "user_id", "ts", "event_id", "price", buckets=8)
    for wanted in (f"NOT {SECOND}", SECOND):
        every.filter(wanted).write.mode("append").parquet(f"{at}/landed")
        listings.run_available(spark.readStream.schema(every.schema).parquet(f"{at}/landed"))
    return listings


@query(f"""WITH {ARRIVED}, s AS (SELECT *, lag(price) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM g WHERE NOT late)
SELECT user_id, arg_max(price, (ts, event_id)) AS price, arg_max(event_id, (ts, event_id)) AS event_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) FILTER (before <> price) AS n_changes FROM s GROUP BY 1""")
def stream_current_listings(spark: SparkSession, d: str) -> DataFrame:
    """The listing table after two runs of the stream, which rewrite the touched partitions alone."""
    return two_runs(spark, d).table.current()


@query(f"WITH {ARRIVED} SELECT user_id, event_id, ts, price, 'LATE' AS reason FROM g WHERE late")
def stream_late_observations(spark: SparkSession, d: str) -> DataFrame:
    """What came too late for the table is in a table of its own."""
    return two_runs(spark, d).late().drop("batch")


@query(f"WITH {ARRIVED}, s AS (SELECT *, lag(price) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM g WHERE NOT late) SELECT user_id, event_id, ts, before AS old_value, price AS new_value FROM s WHERE before <> price")
def stream_listing_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every change of value, in order over both runs."""
    return two_runs(spark, d).changes().drop("batch")


EVENT_KIND = "CASE event_type WHEN 'purchase' THEN 'PRICE_CHANGED' WHEN 'error' THEN 'DESCRIPTION_CHANGED' WHEN 'click' THEN 'SELLER_CHANGED' ELSE 'DISCOVERED' END"
DECIDED = "CASE WHEN total >= 30000000 THEN 'CALL' WHEN total >= 15000000 THEN 'REVIEW' ELSE 'WATCH' END"


@query(f"""WITH e AS (SELECT user_id AS property_id, {EVENT_KIND} AS kind, CAST(ts AS TIMESTAMP) AS ts, CAST(ts AS TIMESTAMP) >= TIMESTAMP '2024-01-15 12:00:00' AS second FROM events), k AS (SELECT * FROM e WHERE kind <> 'DISCOVERED'),
t AS (SELECT o_custkey AS property_id, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total FROM orders GROUP BY 1),
m AS (SELECT property_id, max(ts) AS analysed_at, count(DISTINCT second) AS n_runs, bool_or(kind = 'DESCRIPTION_CHANGED') AS d, bool_or(kind <> 'PRICE_CHANGED') AS s FROM k GROUP BY 1), r AS (SELECT m.*, total, CASE WHEN total IS NULL THEN 'INSUFFICIENT_DATA' ELSE 'SUCCESS' END AS st FROM m LEFT JOIN t USING (property_id))
SELECT property_id, st AS deal_status, st AS opportunity_status, CASE WHEN d THEN 'STALE' ELSE 'NOT_RUN' END AS llm_status, CASE WHEN s THEN st ELSE 'NOT_RUN' END AS risk_status, CASE WHEN s THEN st ELSE 'NOT_RUN' END AS seller_status, CASE WHEN total IS NOT NULL THEN {DECIDED} END AS action, total AS score, analysed_at, n_runs FROM r""")
def stream_incremental_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Events of two deliveries invalidate modules; the decisions of the touched properties alone are computed anew."""
    at = folder(spark)
    every = spark.read.parquet(f"{d}/events.parquet").selectExpr("CAST(user_id AS BIGINT) AS property_id", "event_id", f"{EVENT_KIND} AS event_type", "CAST(ts AS TIMESTAMP) AS at")
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").cast("long").alias("property_id"), cents("o_totalprice").alias("price"))

    def analyse(keys: DataFrame) -> DataFrame:
        own = orders.join(keys, "property_id", "left_semi").groupBy("property_id").agg(F.sum("price").alias("total"))
        return own.select("property_id", F.expr(DECIDED).alias("action"), F.col("total").alias("score"))

    analysis = IncrementalAnalysis(spark, f"{at}/analysis", analyse, buckets=8)
    middle = F.lit("2024-01-15 12:00:00").cast("timestamp")
    for wanted in (F.col("at") < middle, F.col("at") >= middle):
        every.filter(wanted).write.mode("append").parquet(f"{at}/landed")
        analysis.run_available(spark.readStream.schema(every.schema).parquet(f"{at}/landed"))
    return analysis.table.current()
