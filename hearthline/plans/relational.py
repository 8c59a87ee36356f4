"""Queries of scans, joins, aggregates, windows and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthline.functions.numbers import elapsed_days
from hearthline.operators import changes, features, rows, workflow
from hearthline.plans.registry import cents, load, longs, query



def as_of() -> Column:
    return F.lit("2024-01-15 12:00:00").cast("timestamp")


PC = "CAST(round(l_extendedprice * 100) AS BIGINT)"
UNIT = f"(2 * {PC} + CAST(l_quantity AS BIGINT)) // (2 * CAST(l_quantity AS BIGINT))"


def unit_prices(items: DataFrame) -> DataFrame:
    """l_partkey, w (quantity) and unit (price per unit in whole cents, half up)."""
    both = items.select("l_partkey", cents("l_extendedprice").alias("pc"), F.col("l_quantity").cast("long").alias("w"))
    return both.filter("w > 0").select("l_partkey", "w", F.expr("(2 * pc + w) div (2 * w)").alias("unit"))


@query(f"""SELECT l_orderkey, l_linenumber, {UNIT} AS unit_cents, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS flag_rank
FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND l_shipdate >= TIMESTAMP '1996-01-01'""")
def scan_filter_project(spark: SparkSession, d: str) -> DataFrame:
    (li,) = load(spark, d, "lineitem")
    kept = li.filter(F.col("l_quantity").between(10, 20) & F.col("l_returnflag").isin("A", "R") & (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp")))
    both = kept.select("l_orderkey", "l_linenumber", "l_returnflag", cents("l_extendedprice").alias("pc"), F.col("l_quantity").cast("long").alias("w"))
    return both.select("l_orderkey", "l_linenumber", F.expr("(2 * pc + w) div (2 * w)").alias("unit_cents"), F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("flag_rank"))


@query("SELECT p_partkey, nullif(p_size, 10) AS size FROM part WHERE nullif(p_size, 10) IS NULL OR nullif(p_size, 10) BETWEEN 20 AND 30")
def null_tolerant_range(spark: SparkSession, d: str) -> DataFrame:
    (part,) = load(spark, d, "part")
    s = F.nullif("p_size", F.lit(10))
    return part.select("p_partkey", s.alias("size")).filter(F.col("size").isNull() | F.col("size").between(20, 30))


@query("SELECT p_partkey, p_type FROM part WHERE p_type = (SELECT min(p_type) FROM part) OR p_name ILIKE '%RED%'")
def city_or_ilike(spark: SparkSession, d: str) -> DataFrame:
    (part,) = load(spark, d, "part")
    return part.filter((F.col("p_type") == part.agg(F.min("p_type")).scalar()) | F.ilike("p_name", F.lit("%red%"))).select("p_partkey", "p_type")


@query("""SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS price_cents, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total
FROM orders WHERE o_orderstatus = 'F' ORDER BY price_cents DESC, o_orderkey LIMIT 50 OFFSET 100""")
def optional_filters_page(spark: SparkSession, d: str) -> DataFrame:
    (orders,) = load(spark, d, "orders")
    wanted = {"o_orderstatus": "F", "o_orderpriority": None}
    for name, value in wanted.items():
        orders = orders if value is None else orders.filter(F.col(name) == value)
    slim = orders.select("o_orderkey", cents("o_totalprice").alias("price_cents"))
    return rows.page(slim, [F.desc("price_cents"), F.asc("o_orderkey")], 3).withColumn("total", orders.agg(F.count("*")).scalar())


@query("""SELECT r_name, c_mktsegment, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def inner_left_fan(spark: SparkSession, d: str) -> DataFrame:
    o, c, n, r = load(spark, d, "orders", "customer", "nation", "region")
    by_customer = o.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum(cents("o_totalprice")).alias("cents"))
    fan = by_customer.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return fan.groupBy("r_name", "c_mktsegment").agg(F.sum("orders").alias("orders"), F.sum("cents").alias("cents"))


IN_1997 = "l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-03-01'"


@query(f"SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND {IN_1997})")
def semi_exists(spark: SparkSession, d: str) -> DataFrame:
    part, li = load(spark, d, "part", "lineitem")
    return part.join(li.filter(IN_1997), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("p_partkey")


@query(f"""SELECT p_partkey, true AS first_miss, CAST(1 AS BIGINT) AS misses, 'NOT_SEEN' AS status
FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND {IN_1997})""")
def anti_missing(spark: SparkSession, d: str) -> DataFrame:
    part, li = load(spark, d, "part", "lineitem")
    listings = part.select("p_partkey", F.lit("ACTIVE").alias("status"), F.lit(0).cast("long").alias("misses"))
    seen = li.filter(IN_1997).select(F.col("l_partkey").alias("p_partkey"))
    return longs(changes.missing(listings, seen, "p_partkey"), "misses").select("p_partkey", "first_miss", "misses", "status")


@query("""SELECT a.p_partkey, count(*) AS pairs, CAST(sum(b.p_partkey) AS BIGINT) AS others FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey
AND abs(round(a.p_retailprice * 100) - round(b.p_retailprice * 100)) <= 2000 AND 4 * abs(b.p_size - a.p_size) <= a.p_size GROUP BY 1""")
def band_self_join(spark: SparkSession, d: str) -> DataFrame:
    (part,) = load(spark, d, "part")
    a = part.select("p_partkey", "p_brand", "p_size", cents("p_retailprice").alias("pc"))
    b = part.select(F.col("p_partkey").alias("other"), "p_brand", F.col("p_size").alias("size2"), cents("p_retailprice").alias("pc2"))
    # Sizes that fit are few whole numbers: each is a key, and the price band is a place along a line.
    fitting = a.select("p_brand", "p_size", "pc").distinct().withColumn("size2", F.explode(F.expr("sequence(p_size - p_size div 4, p_size + p_size div 4)")))
    found = rows.band_totals(fitting, b, ["p_brand", "size2"], "pc", "pc2", 2000, {"n": F.count("*"), "s": F.sum("other")}, ["p_size"])
    both = a.join(found.groupBy("p_brand", "p_size", "pc").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), ["p_brand", "p_size", "pc"])
    # A part is not its own pair.
    return both.select("p_partkey", (F.col("n") - 1).alias("pairs"), (F.col("s") - F.col("p_partkey")).alias("others")).filter("pairs > 0")


GEO = """44.75::DOUBLE + ({k} * 37 % 1000) / 10000.0::DOUBLE AS lat{n}, 20.40::DOUBLE + ({k} * 91 % 1000) / 10000.0::DOUBLE AS lon{n}"""


@query(f"""WITH s AS (SELECT s_suppkey, {GEO.format(k="s_suppkey", n="")} FROM supplier), c AS (SELECT c_custkey, {GEO.format(k="c_custkey", n="2")} FROM customer),
p AS (SELECT *, 2 * 6371008.77 * asin(sqrt(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2))) AS m FROM s, c)
SELECT s_suppkey, c_custkey, CAST(floor(m) AS BIGINT) AS metres FROM p WHERE m <= 1200""")
def geo_radius_join(spark: SparkSession, d: str) -> DataFrame:
    s, c = load(spark, d, "supplier", "customer")
    place = lambda key, n: [(44.75 + (F.col(key) * 37 % 1000) / 10000.0).alias(f"lat{n}"), (20.40 + (F.col(key) * 91 % 1000) / 10000.0).alias(f"lon{n}")]
    s, c = s.select("s_suppkey", *place("s_suppkey", "")), c.select("c_custkey", *place("c_custkey", "2"))
    return rows.radius_pairs(s, c, 1200.0).select("s_suppkey", "c_custkey", F.floor("distance_m").cast("long").alias("metres"))


@query("""SELECT user_id, event_id, ts, event_type FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def asof_latest(spark: SparkSession, d: str) -> DataFrame:
    (ev,) = load(spark, d, "events")
    return rows.asof_latest(ev.select("user_id", "event_id", "ts", "event_type"), ["user_id"], "ts", as_of(), ["event_id"])


@query("""SELECT user_id, event_id, ts, event_type FROM events WHERE ts > TIMESTAMP '2024-01-15 12:00:00'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
def asof_forward(spark: SparkSession, d: str) -> DataFrame:
    (ev,) = load(spark, d, "events")
    return rows.asof_first_after(ev.select("user_id", "event_id", "ts", "event_type"), ["user_id"], "ts", as_of(), ["event_id"])


@query("""SELECT user_id, event_id, value FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' AND event_type = 'purchase'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def asof_status_predicate(spark: SparkSession, d: str) -> DataFrame:
    (ev,) = load(spark, d, "events")
    slim = ev.select("user_id", "event_id", "ts", "event_type", "value")
    return rows.asof_latest(slim, ["user_id"], "ts", as_of(), ["event_id"], F.col("event_type") == "purchase").select("user_id", "event_id", "value")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_ranked_row(spark: SparkSession, d: str) -> DataFrame:
    (o,) = load(spark, d, "orders")
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    slim = o.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate", rank.alias("r"))
    return rows.latest_row(slim, ["o_custkey"], [F.asc("r"), F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""SELECT e.event_type, b.bucket, (SELECT count(*) FROM events x WHERE x.event_type = e.event_type AND x.user_id % 7 = b.bucket AND x.value > 50) AS n
FROM (SELECT DISTINCT event_type FROM events) e, (SELECT unnest(generate_series(0, 6)) AS bucket) b""")
def group_counts_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    (ev,) = load(spark, d, "events")
    counts = ev.filter("value > 50").groupBy("event_type", (F.col("user_id") % 7).alias("bucket")).agg(F.count("*").alias("n"))
    domain = ev.select("event_type").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    return domain.join(counts, ["event_type", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("""SELECT event_type, count(*) FILTER (user_id % 3 = 0) AS b0, count(*) FILTER (user_id % 3 = 1) AS b1, count(*) FILTER (user_id % 3 = 2) AS b2 FROM events GROUP BY 1""")
def pivot_counts(spark: SparkSession, d: str) -> DataFrame:
    (ev,) = load(spark, d, "events")
    wide = ev.withColumn("b", F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string"))).groupBy("event_type").pivot("b", ["b0", "b1", "b2"])
    return wide.count().na.fill(0)


LISTING = """SELECT l_partkey AS property_id, CASE WHEN l_linestatus = 'O' THEN 'ACTIVE' ELSE 'REMOVED' END AS status, CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
l_shipdate AS first_seen, CASE l_returnflag WHEN 'A' THEN 'AGENCY' WHEN 'R' THEN 'OWNER' ELSE 'OTHER' END AS seller FROM lineitem"""
DAYS = "CAST(greatest(floor((epoch_us(TIMESTAMP '2002-01-01') - epoch_us({x})) / 86400000000), 0) AS BIGINT)"


@query(f"""WITH t AS ({LISTING}) SELECT property_id, count(*) FILTER (status = 'ACTIVE') AS active_count, count(*) AS known_count, min(price) FILTER (status = 'ACTIVE' AND price > 0) AS lowest_price,
max(price) FILTER (status = 'ACTIVE' AND price > 0) AS highest_price, {DAYS.format(x="coalesce(max(first_seen) FILTER (status = 'ACTIVE'), max(first_seen))")} AS listing_age_days,
{DAYS.format(x="min(first_seen)")} AS market_age_days, greatest(count(*) - 1, 0) AS relist_count, coalesce(bool_or(status = 'ACTIVE' AND seller = 'OWNER'), false) AS owner_present,
count(*) FILTER (status = 'ACTIVE' AND seller = 'AGENCY') AS agency_count FROM t GROUP BY 1""")
def listing_aggregates(spark: SparkSession, d: str) -> DataFrame:
    load(spark, d, "lineitem")[0].createOrReplaceTempView("_li_aggregates")
    listings = spark.sql(LISTING.replace("lineitem", "_li_aggregates"))
    out = features.listing_aggregates(listings, F.lit("2002-01-01").cast("timestamp"))
    return longs(out, "listing_age_days", "market_age_days")


STEPS = """SELECT user_id, ts AS seen, event_id, lag(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_price, CAST(round(value * 100) AS BIGINT) AS new_price FROM events"""
BP = "((({o}) - ({n})) * 2000000 + ({o})) // (2 * ({o}))"


def price_steps(ev: DataFrame) -> DataFrame:
    new = cents("value")
    return ev.select("user_id", F.col("ts").alias("at"), "event_id", F.lag(new).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("old_price"), new.alias("new_price"))


def total_bp(window: str) -> str:
    old, low = f"arg_min(old_price, (seen, event_id)){window}", f"min(new_price){window}"
    return f"coalesce(CASE WHEN {low} < {old} THEN {BP.format(o=old, n=low)} ELSE 0 END, 0)"


@query(f"""WITH s AS ({STEPS}), c AS (SELECT * FROM s WHERE new_price < old_price) SELECT user_id, count(*) AS cut_count, CAST({total_bp("")} AS BIGINT) AS total_pct,
CAST({total_bp(" FILTER (seen >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 7 DAYS)")} AS BIGINT) AS pct_7d, CAST({total_bp(" FILTER (seen >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 30 DAYS)")} AS BIGINT) AS pct_30d,
CAST(max({BP.format(o="old_price", n="new_price")}) AS BIGINT) AS largest_pct, max(seen) AS last_cut_at FROM c GROUP BY 1""")
def price_cuts(spark: SparkSession, d: str) -> DataFrame:
    (ev,) = load(spark, d, "events")
    in_units = lambda o, n: F.when((o > 0) & (n < o), F.floor(((o - n) * 2000000 + o) / (2 * o))).otherwise(F.lit(0)).cast("long")
    return longs(features.price_cuts(price_steps(ev), "user_id", as_of(), in_units), "total_pct", "pct_7d", "pct_30d", "largest_pct")


@query(f"""WITH u AS (SELECT l_partkey, CAST(l_quantity AS BIGINT) AS w, {UNIT} AS unit FROM lineitem WHERE l_quantity > 0),
r AS (SELECT *, sum(w) OVER (PARTITION BY l_partkey ORDER BY unit) AS run, sum(w) OVER (PARTITION BY l_partkey) AS total FROM u)
SELECT l_partkey, min(unit) AS median_cents FROM r WHERE 2 * run >= total GROUP BY 1""")
def val_weighted_median(spark: SparkSession, d: str) -> DataFrame:
    (li,) = load(spark, d, "lineitem")
    return rows.weighted_median(unit_prices(li), ["l_partkey"], "unit", "w", "median_cents")


@query("""WITH p AS (SELECT p_brand, CAST(round(p_retailprice * 100) AS BIGINT) AS pc FROM part), q AS (SELECT p_brand, quantile_cont(pc, 0.25) AS q25, quantile_cont(pc, 0.75) AS q75, count(*) AS n FROM p GROUP BY 1)
SELECT p.p_brand, CAST(round(4 * q25) AS BIGINT) AS q25_x4, CAST(round(4 * q75) AS BIGINT) AS q75_x4, count(*) FILTER (n >= 5 AND q75 > q25 AND (pc < q25 - 0.5 * (q75 - q25) OR pc > q75 + 0.5 * (q75 - q25))) AS outliers
FROM p JOIN q ON p.p_brand = q.p_brand GROUP BY ALL""")
def iqr_outliers(spark: SparkSession, d: str) -> DataFrame:
    (part,) = load(spark, d, "part")
    marked = rows.iqr_marked(part.select("p_brand", cents("p_retailprice").alias("pc")), ["p_brand"], "pc", reach=0.5)
    return marked.groupBy("p_brand", F.round(4 * F.col("q25")).cast("long").alias("q25_x4"), F.round(4 * F.col("q75")).cast("long").alias("q75_x4")).agg(F.count_if("outlier").alias("outliers"))


@query(f"SELECT l_suppkey, CAST(sum({PC} * CAST(l_quantity AS BIGINT)) // sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS mean_cents FROM lineitem GROUP BY 1")
def weighted_average(spark: SparkSession, d: str) -> DataFrame:
    (li,) = load(spark, d, "lineitem")
    sums = li.groupBy("l_suppkey").agg(F.sum(cents("l_extendedprice") * F.col("l_quantity").cast("long")).alias("s"), F.sum(F.col("l_quantity").cast("long")).alias("w"))
    return sums.select("l_suppkey", F.expr("s div w").alias("mean_cents"))


@query("""SELECT source, lang, arg_max(doc_id, (length(text), -doc_id)) AS doc_id, max(length(text)) AS n FROM documents GROUP BY ALL""")
def argmax_text(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = load(spark, d, "documents")
    best = F.max(F.struct(F.length("text").cast("long").alias("n"), (-F.col("doc_id")).alias("k")))
    return docs.groupBy("source", "lang").agg(best.alias("b")).select("source", "lang", (-F.col("b.k")).alias("doc_id"), "b.n")


@query("""SELECT 'order' AS kind, o_custkey AS key, o_orderkey AS ident, o_orderdate AS at FROM orders
UNION ALL SELECT 'event', user_id, event_id, ts FROM events""")
def timeline_union(spark: SparkSession, d: str) -> DataFrame:
    o, ev = load(spark, d, "orders", "events")
    a = o.select(F.lit("order").alias("kind"), F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("ident"), F.col("o_orderdate").alias("at"))
    b = ev.select(F.lit("event").alias("kind"), F.col("user_id").alias("key"), F.col("event_id").alias("ident"), F.col("ts").alias("at"))
    return workflow.timeline([a, b])


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def raw_dedupe(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = load(spark, d, "documents")
    return docs.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""WITH r AS (SELECT *, sum(CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
q AS (SELECT *, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM r),
s AS (SELECT user_id, min(pos) AS stop FROM q WHERE run = 3 GROUP BY 1) SELECT q.user_id, count(*) AS kept, max(event_id) AS last_id FROM q LEFT JOIN s ON q.user_id = s.user_id WHERE stop IS NULL OR pos <= stop GROUP BY 1""")
def known_boundary_stop(spark: SparkSession, d: str) -> DataFrame:
    (ev,) = load(spark, d, "events")
    cards = ev.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"), F.col("event_type").isin("view", "click").alias("known"))
    kept = changes.known_boundary(cards, "user_id", "pos", "known", 3)
    return kept.groupBy("user_id").agg(F.count("*").alias("kept"), F.max("event_id").alias("last_id"))


@query("""SELECT user_id, count(*) FILTER (ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 3 DAYS) AS d3, count(*) FILTER (ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 7 DAYS) AS d7,
count(*) FILTER (ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 14 DAYS) AS d14, CAST(greatest(floor((epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(max(ts))) / 86400000000), 0) AS BIGINT) AS idle_days
FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1""")
def elapsed_days_windows(spark: SparkSession, d: str) -> DataFrame:
    (ev,) = load(spark, d, "events")
    counts = [F.count_if(F.col("ts") >= as_of() - F.expr(f"INTERVAL {n} DAYS")).alias(f"d{n}") for n in (3, 7, 14)]
    return ev.filter(F.col("ts") <= as_of()).groupBy("user_id").agg(*counts, elapsed_days(as_of(), F.max("ts")).cast("long").alias("idle_days"))


@query("""WITH e AS (SELECT event_id, user_id, event_type FROM events), n AS (SELECT a.n_nationkey, a.n_name, min(b.n_name) AS neighbour FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY ALL)
SELECT n_name, neighbour, count(*) AS events FROM e JOIN customer ON user_id = c_custkey JOIN n ON c_nationkey = n_nationkey GROUP BY ALL""")
def fk_joins_alias(spark: SparkSession, d: str) -> DataFrame:
    ev, c, n = load(spark, d, "events", "customer", "nation")
    a, b = n.alias("a"), n.alias("b")
    near = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") != F.col("b.n_nationkey"))).groupBy("a.n_nationkey", "a.n_name").agg(F.min("b.n_name").alias("neighbour"))
    per_user = ev.groupBy("user_id").agg(F.count("*").alias("k"))
    return per_user.join(c, F.col("user_id") == F.col("c_custkey")).join(near, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "neighbour").agg(F.sum("k").alias("events"))


@query("""SELECT p_partkey, coalesce(nullif(p_size, 10), CAST(b.size AS INT)) AS size FROM part LEFT JOIN (SELECT l_partkey, CAST(max(l_quantity) AS INT) AS size FROM lineitem GROUP BY 1) b ON l_partkey = p_partkey""")
def coalesce_fill(spark: SparkSession, d: str) -> DataFrame:
    part, li = load(spark, d, "part", "lineitem")
    target = part.select("p_partkey", F.nullif("p_size", F.lit(10)).alias("size"))
    best = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").cast("int").alias("size"))
    return features.fill_unknown(target, best, "p_partkey", ["size"])


@query("""WITH e AS (SELECT source, regexp_extract_all(lower(text), '[a-z]+') AS words FROM documents), w AS (SELECT source, unnest(words) AS word FROM e),
c AS (SELECT source, word, count(*) AS n FROM w GROUP BY ALL) SELECT source, word, n FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, word) <= 5""")
def explode_slice(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = load(spark, d, "documents")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    counts = docs.select("source", F.explode(words).alias("word")).groupBy("source", "word").agg(F.count("*").alias("n"))
    return rows.top_k(counts, ["source"], [F.desc("n"), F.asc("word")], 5).drop("rank")
