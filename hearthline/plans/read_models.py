"""Dashboard read models: fans of latest rows, ordered and paged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.operators import rows
from hearthline.plans.registry import cents, load, query

PRICE = "CAST(round(o_totalprice * 100) AS BIGINT)"
LATEST = f"""l AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, arg_max({PRICE}, (o_orderdate, o_orderkey)) AS price, max(o_orderdate) AS at FROM orders GROUP BY 1),
e AS (SELECT user_id, max(ts) AS last_event, count(*) AS events FROM events GROUP BY 1)"""


def fan(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their latest order, event summary and nation; one row each."""
    c, o, ev, n = load(spark, d, "customer", "orders", "events", "nation")
    slim = o.select(F.col("o_custkey").alias("key"), "o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("status"), cents("o_totalprice").alias("price"))
    last = slim.groupBy("key").agg(F.max(F.struct("o_orderdate", "o_orderkey", "status", "price")).alias("l")).select("key", "l.*")
    seen = ev.groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("last_event"), F.count("*").alias("events"))
    names = n.select("n_nationkey", "n_name")
    base = c.select(F.col("c_custkey").alias("key"), "c_name", "c_nationkey", "c_mktsegment", cents("c_acctbal").alias("balance"))
    return rows.left_fan(base, [last, seen], "key").join(names, F.col("c_nationkey") == F.col("n_nationkey"), "left")


@query(f"""WITH {LATEST} SELECT c_custkey AS key, status, price, n_name, events FROM customer LEFT JOIN l ON c_custkey = o_custkey LEFT JOIN e ON c_custkey = user_id LEFT JOIN nation ON c_nationkey = n_nationkey
ORDER BY CASE status WHEN 'O' THEN 2 WHEN 'P' THEN 1 ELSE 0 END DESC, price DESC NULLS LAST, c_custkey LIMIT 100""")
def action_queue(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("status") == "O", 2).when(F.col("status") == "P", 1).otherwise(0)
    table = fan(spark, d).select("key", "status", "price", "n_name", "events")
    return rows.page(table, [rank.desc(), F.desc_nulls_last("price"), F.asc("key")], 1, 100)


@query(f"""WITH {LATEST} SELECT c_custkey AS key, CAST(round(c_acctbal * 100) AS BIGINT) - price AS gap, last_event FROM customer LEFT JOIN l ON c_custkey = o_custkey LEFT JOIN e ON c_custkey = user_id WHERE c_mktsegment = 'BUILDING'
ORDER BY CASE WHEN gap >= 0 THEN 1 ELSE 0 END DESC, gap NULLS LAST, last_event DESC NULLS LAST, key LIMIT 50""")
def watchlist(spark: SparkSession, d: str) -> DataFrame:
    table = fan(spark, d).filter("c_mktsegment = 'BUILDING'").select("key", (F.col("balance") - F.col("price")).alias("gap"), "last_event")
    order = [F.coalesce(F.col("gap") >= 0, F.lit(False)).desc(), F.asc_nulls_last("gap"), F.desc_nulls_last("last_event"), F.asc("key")]
    return rows.page(table, order, 1)


@query(f"""WITH {LATEST} SELECT c_custkey AS key, c_name, n_name, status, price, events FROM customer LEFT JOIN l ON c_custkey = o_custkey LEFT JOIN e ON c_custkey = user_id LEFT JOIN nation ON c_nationkey = n_nationkey WHERE status IS NOT NULL""")
def properties_list(spark: SparkSession, d: str) -> DataFrame:
    return fan(spark, d).filter("status is not null").select("key", "c_name", "n_name", "status", "price", "events")


@query(f"""WITH {LATEST} SELECT coalesce(status, 'NONE') AS status, count(*) AS n, CAST(sum(price) AS BIGINT) AS cents, count(*) FILTER (events > 60) AS busy FROM customer LEFT JOIN l ON c_custkey = o_custkey LEFT JOIN e ON c_custkey = user_id GROUP BY 1""")
def pipeline_board(spark: SparkSession, d: str) -> DataFrame:
    return fan(spark, d).groupBy(F.coalesce("status", F.lit("NONE")).alias("status")).agg(F.count("*").alias("n"), F.sum("price").alias("cents"), F.count_if(F.col("events") > 60).alias("busy"))


@query(f"""SELECT o_custkey AS key, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS closed, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS priority, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS states,
array_to_string(list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC)[1:5], ',') AS recent FROM orders GROUP BY 1""")
def property_detail(spark: SparkSession, d: str) -> DataFrame:
    (o,) = load(spark, d, "orders")
    slim = o.select(F.col("o_custkey").alias("key"), "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    latest = F.max(F.struct("o_orderdate", "o_orderkey", "o_orderpriority")).alias("l")
    totals = slim.groupBy("key").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"), latest, F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("states"))
    top = rows.top_k(slim, ["key"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "o_orderkey"))).alias("r"))
    recent = F.array_join(F.col("r.o_orderkey").cast("array<string>"), ",")
    return totals.join(top, "key").select("key", "orders", "closed", "first_at", "last_at", F.col("l.o_orderpriority").alias("priority"), "states", recent.alias("recent"))
