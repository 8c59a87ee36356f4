"""Whole valuations and liquidity assessments: suppliers stand for properties, parts for listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.functions.numbers import elapsed_days
from hearthline.operators import liquidity, valuation
from hearthline.plans.registry import load, query

AS_OF = "2024-06-01"

# The facts of a property by its number k, in SQL that both engines read.
FACTS = """CASE k % 5 WHEN 0 THEN NULL ELSE 1 + (k % 7) / CAST(2 AS DOUBLE) END AS rooms, CASE WHEN k % 8 > 0 THEN k % 10 END AS floor, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS elevator,
CASE k % 4 WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true END AS parking, CASE k % 6 WHEN 0 THEN 'good' WHEN 1 THEN 'RENOVATED' WHEN 2 THEN 'needs work' WHEN 3 THEN 'LUX' WHEN 4 THEN 'RUIN' END AS condition,
CASE k % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'Old' WHEN 2 THEN ' ' WHEN 3 THEN 'brick' END AS building, CASE WHEN k % 7 > 0 THEN 1950 + k % 70 END AS year, CASE k % 3 WHEN 0 THEN 'gas' WHEN 1 THEN 'Central' END AS heating,
CASE k % 4 WHEN 0 THEN 'Blok 45' WHEN 1 THEN 'Sremska' END AS micro, CASE k % 3 WHEN 0 THEN 'North' WHEN 1 THEN 'south' END AS neighborhood, CASE k % 2 WHEN 0 THEN 'M1' END AS municipality"""

TARGETS = f"""SELECT k AS property_id, CASE WHEN k % 11 = 0 THEN 'HOUSE' ELSE 'APARTMENT' END AS property_type, CASE WHEN k % 13 > 0 THEN CAST(20 + k % 30 AS DOUBLE) END AS size, {FACTS},
CASE WHEN k % 10 > 0 THEN n_name END AS city, CASE k % 3 WHEN 0 THEN 'CITY' WHEN 1 THEN 'MICROZONE' ELSE 'MUNICIPALITY' END AS precision, CAST(40 + k % 60 AS BIGINT) AS quality, CAST(3000000 + k % 37 * 100000 AS BIGINT) AS asking_cents,
CASE WHEN k % 3 = 0 THEN (44800 + k % 17) / CAST(1000 AS DOUBLE) END AS lat, CASE WHEN k % 3 = 0 THEN (20400 + k % 19) / CAST(1000 AS DOUBLE) END AS lon"""

LISTINGS = f"""SELECT k AS listing_id, k AS property_id, 'APARTMENT' AS property_type, CASE WHEN k % 12 = 0 THEN 'REMOVED' ELSE 'ACTIVE' END AS status, CASE WHEN k % 31 = 0 THEN 'RSD' ELSE 'EUR' END AS currency,
k * 7 % 400 AS age, CAST(round(p_retailprice * 100) AS BIGINT) * 40 AS price_cents, CAST(p_size AS DOUBLE) AS size, {FACTS},
CASE WHEN k % 5 < 3 THEN n_name END AS city, CASE WHEN k % 5 = 3 THEN concat('Grad ', lower(n_name)) END AS city_raw, CASE WHEN k % 5 = 4 THEN concat(n_name, ' centar') END AS location_raw,
CASE WHEN k % 2 = 0 THEN (44800 + k % 17) / CAST(1000 AS DOUBLE) END AS lat, CASE WHEN k % 2 = 0 THEN (20400 + k % 19) / CAST(1000 AS DOUBLE) END AS lon"""

SUPPLIERS = "SELECT s_suppkey AS k, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"
PARTS = "SELECT p_partkey AS k, p_retailprice, p_size, n_name FROM part JOIN nation ON p_partkey % 25 = n_nationkey"


def same(f: str) -> str:
    return f"coalesce(trim(t.{f}) <> '' AND lower(trim(t.{f})) = lower(trim(l.{f})), false)"


def level(c: str) -> str:
    return f"CASE {c} WHEN 'good' THEN 3 WHEN 'RENOVATED' THEN 4 WHEN 'needs work' THEN 1 WHEN 'LUX' THEN 5 WHEN 'RUIN' THEN 0 END"


def gap(a: str, b: str, steps: list[tuple[float, int]], other: int, unknown: int) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN {unknown} " + " ".join(f"WHEN abs({a} - {b}) <= {k} THEN {v}" for k, v in steps) + f" ELSE {other} END"


def flag(f: str) -> str:
    return f"CASE WHEN t.{f} IS NULL OR l.{f} IS NULL THEN 4000 WHEN t.{f} = l.{f} THEN 10000 ELSE 2500 END"


METRES = "2 * 6371008.77 * asin(sqrt(pow(sin(radians(t.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - l.lon) / 2), 2)))"

VALUED = f"""WITH sk AS ({SUPPLIERS}), pk AS ({PARTS}), t0 AS ({TARGETS} FROM sk), l AS (SELECT * FROM ({LISTINGS} FROM pk) WHERE status = 'ACTIVE' AND currency = 'EUR'),
t AS (SELECT *, CASE WHEN property_type <> 'APARTMENT' THEN 'UNSUPPORTED_PROPERTY_TYPE' WHEN size IS NULL THEN 'MISSING_TARGET_SIZE' WHEN lat IS NULL AND concat(micro, neighborhood, municipality, city) = '' THEN 'MISSING_TARGET_LOCATION' END AS issue FROM t0),
j AS (SELECT t.property_id AS id, l.listing_id, l.age, l.price_cents, l.size AS lsize, l.condition AS lcond, l.parking AS lpark, CASE WHEN t.lat IS NOT NULL THEN round({METRES}, 2) END AS dist,
CASE WHEN {same("micro")} THEN 8500 WHEN {same("neighborhood")} THEN 6500 WHEN {same("municipality")} THEN 4000 WHEN {same("city")} THEN 2500 ELSE 0 END AS by_text,
CASE WHEN abs(l.size - t.size) / t.size <= 0.05 THEN 10000 WHEN abs(l.size - t.size) / t.size <= 0.10 THEN 9000 WHEN abs(l.size - t.size) / t.size <= 0.15 THEN 7500 WHEN abs(l.size - t.size) / t.size <= 0.20 THEN 5500 ELSE 3000 END AS s_size,
{gap(level("t.condition"), level("l.condition"), [(0, 10000), (1, 7000), (2, 4000)], 2000, 3500)} AS s_cond, {gap("t.rooms", "l.rooms", [(0, 10000), (0.5, 8000), (1, 5000)], 2000, 3500)} AS s_rooms,
CASE WHEN {same("building")} THEN 10000 ELSE 4000 END AS s_build, CASE WHEN {same("heating")} THEN 10000 ELSE 4000 END AS s_heat, {gap("t.floor", "l.floor", [(0, 10000), (1, 8500), (3, 5500)], 2500, 4000)} AS s_floor,
{flag("elevator")} AS s_lift, {flag("parking")} AS s_park, {gap("t.year", "l.year", [(5, 10000), (15, 7000), (30, 4500)], 2500, 4500)} AS s_year
FROM t JOIN l ON l.property_id <> t.property_id AND l.size BETWEEN t.size * 0.75 AND t.size * 1.25 AND (t.city IS NULL OR coalesce(l.city = t.city, false) OR coalesce(l.city_raw ILIKE concat('%', t.city, '%'), false) OR coalesce(l.location_raw ILIKE concat('%', t.city, '%'), false))
WHERE issue IS NULL AND (t.lat IS NULL OR (l.lat IS NOT NULL AND {METRES} <= 1200))),
s AS (SELECT *, (25 * CASE WHEN dist IS NULL THEN by_text WHEN dist <= 100 THEN 10000 WHEN dist <= 300 THEN 9000 WHEN dist <= 500 THEN 7500 WHEN dist <= 800 THEN 6000 WHEN dist <= 1200 THEN 4500 ELSE 0 END
+ 20 * s_size + 15 * s_cond + 10 * s_rooms + 10 * s_build + 8 * ((55 * s_floor + 45 * s_lift) // 100) + 5 * s_year + 3 * s_park + 2 * s_heat + 2 * 7000 + 50) // 100 AS sim,
CASE WHEN age <= 90 THEN 100 WHEN age <= 180 THEN 85 WHEN age <= 365 THEN 60 ELSE 25 END AS rec, (2 * price_cents + CAST(lsize AS BIGINT)) // (2 * CAST(lsize AS BIGINT)) AS m2 FROM j),
n AS (SELECT id, CASE WHEN count(*) FILTER (dist <= 300) >= 4 THEN 300 WHEN count(*) FILTER (dist <= 500) >= 4 THEN 500 WHEN count(*) FILTER (dist <= 800) >= 4 THEN 800 ELSE 1200 END AS radius FROM s WHERE dist IS NOT NULL AND sim >= 4500 AND age <= 365 GROUP BY id),
r AS (SELECT s.*, CASE WHEN dist IS NOT NULL THEN coalesce(radius, 1200) END AS radius, (sim * 6 * rec + 500) // 1000 AS w, CASE WHEN age > 365 THEN 'TOO_OLD' WHEN sim < 4500 THEN 'LOW_SIMILARITY' END AS excluded FROM s LEFT JOIN n USING (id) WHERE dist IS NULL OR dist <= coalesce(radius, 1200)),
k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY excluded IS NULL DESC, sim DESC, w DESC, coalesce(nullif(dist, 0), 999999), age, listing_id) <= 12),
q AS (SELECT id, count(*) AS c, quantile_cont(m2, 0.25) AS q1, quantile_cont(m2, 0.75) AS q3 FROM k WHERE excluded IS NULL GROUP BY id),
o AS (SELECT k.*, excluded IS NULL AND NOT (c >= 5 AND q3 > q1 AND (m2 < q1 - 1.5 * (q3 - q1) OR m2 > q3 + 1.5 * (q3 - q1))) AS fits FROM k LEFT JOIN q USING (id)),
x AS (SELECT *, fits AND count(*) FILTER (fits) OVER (PARTITION BY id) >= 3 AS used, {level("lcond")} AS lv FROM o),
g AS (SELECT id, count(*) AS candidates, count(*) FILTER (used) AS n, max(radius) AS radius, quantile_cont(m2, 0.25) FILTER (used) AS q1, quantile_cont(m2, 0.5) FILTER (used) AS q2, quantile_cont(m2, 0.75) FILTER (used) AS q3,
sum(sim) FILTER (used) / count(*) FILTER (used) / 10000 AS ms, sum(rec) FILTER (used) / count(*) FILTER (used) / 100 AS mr, sum(lv * w) FILTER (used) / nullif(sum(w) FILTER (used AND lv IS NOT NULL), 0) AS lvl,
sum(CASE WHEN lpark THEN w ELSE 0 END) FILTER (used) / nullif(sum(w) FILTER (used AND lpark IS NOT NULL), 0) AS share FROM x GROUP BY id),
m AS (SELECT id, min(m2) AS base FROM (SELECT id, m2, 2 * sum(w) OVER (PARTITION BY id ORDER BY m2) >= sum(w) OVER (PARTITION BY id) AS half FROM x WHERE used AND w > 0) WHERE half GROUP BY id),
a AS (SELECT t.*, coalesce(candidates, 0) AS candidates, radius, coalesce(issue, CASE WHEN coalesce(n, 0) < 3 THEN 'NOT_ENOUGH_INCLUDED_COMPS' END) AS reason, n, base, ms, mr,
CAST(round(CAST(abs((q3 - q1) / q2) AS DECIMAL(18, 8)), 4) AS DOUBLE) AS disp, {level("condition")} AS own, least(15, greatest(-25, coalesce(({level("condition")} - round(CAST(lvl AS DECIMAL(18, 10)), 4)) * 3, 0)
+ CASE WHEN parking AND share < 0.5 THEN 2 WHEN NOT parking AND share > 0.5 THEN -2 ELSE 0 END)) AS adj FROM t LEFT JOIN g ON id = property_id LEFT JOIN m USING (id)),
b AS (SELECT *, CASE WHEN reason IS NULL THEN CAST(round(CAST(least(100, greatest(0, CASE WHEN n >= 8 THEN 20 WHEN n >= 4 THEN 14 ELSE 8 END + 25 * ms + 0.15 * CAST(quality AS DOUBLE) + CASE WHEN disp <= 0.03 THEN 10 WHEN disp <= 0.08 THEN 7 WHEN disp <= 0.15 THEN 4 ELSE 1 END
+ 10 * mr - CASE WHEN precision <> 'MICROZONE' THEN 5 ELSE 0 END - CASE WHEN own IS NULL THEN 5 ELSE 0 END)) AS DECIMAL(14, 6)), 2) AS DOUBLE) ELSE 0.0 END AS confidence FROM a),
e AS (SELECT *, (2 * base * (1000000 + CAST(round(adj * 10000) AS BIGINT)) + 1000000) // 2000000 AS adjusted, CAST(round(10000 * least(0.35, greatest(0.08, 0.10 + CASE WHEN confidence < 40 THEN 0.12 WHEN confidence < 60 THEN 0.08 WHEN confidence < 75 THEN 0.05 ELSE 0 END
+ CASE WHEN n < 4 THEN 0.08 WHEN n < 8 THEN 0.04 ELSE 0 END + least(0.10, disp) + CASE WHEN quality < 60 THEN 0.05 ELSE 0 END))) AS BIGINT) AS width FROM b),
f AS (SELECT *, CAST((2 * adjusted * CAST(size * 100 AS BIGINT) + 100) // 200 AS BIGINT) AS fair FROM e),
v AS (SELECT property_id, CASE WHEN reason IS NULL THEN 'SUCCESS' ELSE 'INSUFFICIENT_DATA' END AS status, reason, candidates AS candidate_count, CASE WHEN reason IS NULL THEN n ELSE 0 END AS included_count, CAST(radius AS BIGINT) AS radius_m,
CASE WHEN reason IS NULL THEN base END AS base_m2, CASE WHEN reason IS NULL THEN CAST(adjusted AS BIGINT) END AS adjusted_m2, CASE WHEN reason IS NULL THEN fair END AS fair_cents, CASE WHEN reason IS NULL THEN (2 * fair * (10000 - width) + 10000) // 20000 END AS low_cents,
CASE WHEN reason IS NULL THEN (2 * fair * (10000 + width) + 10000) // 20000 END AS high_cents, confidence, CASE WHEN reason IS NULL THEN disp END AS dispersion, CASE WHEN reason IS NULL THEN CAST(round(adj * 10000) AS BIGINT) END AS adjustment_units FROM f)"""


def properties(spark: SparkSession, d: str) -> DataFrame:
    s, n = load(spark, d, "supplier", "nation")
    numbered = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("k"), "n_name")
    return numbered.selectExpr(*_columns(TARGETS))


def listings(spark: SparkSession, d: str) -> DataFrame:
    p, n = load(spark, d, "part", "nation")
    numbered = p.join(F.broadcast(n), F.col("p_partkey") % 25 == F.col("n_nationkey")).select(F.col("p_partkey").alias("k"), "p_retailprice", "p_size", "n_name")
    at = F.lit(AS_OF).cast("timestamp")
    dated = numbered.selectExpr(*_columns(LISTINGS)).withColumns({"last_seen": at - F.make_dt_interval(F.col("age").cast("int")), "first_seen": at - F.make_dt_interval(F.col("age").cast("int") + 1)})
    return valuation.eligible(dated, at).withColumn("age_days", elapsed_days(at, F.col("last_seen")))


def _columns(select: str) -> list[str]:
    """The expressions of a SELECT list, cut at commas outside of brackets and CASEs."""
    out, depth = [""], 0
    for word in select.removeprefix("SELECT ").replace("(", " ( ").replace(")", " ) ").replace(",", " , ").split():
        depth += (word in ("(", "CASE")) - (word in (")", "END"))
        if word == "," and not depth:
            out.append("")
        else:
            out[-1] += f" {word}"
    return out


@query(VALUED + " SELECT * FROM v")
def valuation_full(spark: SparkSession, d: str) -> DataFrame:
    """Gate, comparables by radius or by city, exclusions, robust median, adjustment, confidence and range."""
    out = valuation.valued(properties(spark, d), listings(spark, d))
    return out.withColumns({"radius_m": F.col("radius_m").cast("long"), "adjustment_units": F.round(F.col("adjustment_pct") * 10_000).cast("long")}).drop("adjustment_pct")


@query(VALUED + f""", u AS (SELECT t.*, v.status AS vs, v.fair_cents, v.included_count AS n, v.confidence AS vc, v.dispersion AS disp, {level("condition")} AS lv FROM t JOIN v USING (property_id)),
pt AS (SELECT *, CASE WHEN micro = 'Blok 45' THEN 14 WHEN micro IS NOT NULL THEN 8 WHEN neighborhood IS NOT NULL THEN 5 WHEN municipality IS NOT NULL OR city IS NOT NULL THEN -8 END AS p1, CASE WHEN size >= 35 THEN 12 WHEN size >= 25 THEN 4 ELSE -10 END AS p2,
CASE WHEN rooms IS NULL THEN NULL WHEN rooms BETWEEN 1.5 AND 3.5 THEN 6 WHEN rooms <= 1 OR rooms >= 5 THEN -4 ELSE 0 END AS p3,
CASE WHEN floor IS NULL THEN NULL WHEN elevator IS NULL THEN CASE WHEN floor BETWEEN 1 AND 6 THEN 3 ELSE 0 END WHEN floor >= 7 AND NOT elevator THEN -12 WHEN floor >= 4 AND NOT elevator THEN -8 WHEN floor BETWEEN 1 AND 6 THEN 6 WHEN floor = 0 THEN -3 ELSE 2 END AS p4,
CASE lv WHEN 5 THEN 10 WHEN 4 THEN 10 WHEN 3 THEN 6 WHEN 1 THEN -8 WHEN 0 THEN -14 END AS p5, CASE WHEN parking THEN 3 WHEN NOT parking THEN -2 END AS p6, CASE building WHEN 'new' THEN 4 WHEN 'Old' THEN -4 WHEN 'brick' THEN 0 END AS p7,
CASE WHEN asking_cents <= fair_cents THEN 3 WHEN asking_cents <= 1.05 * fair_cents THEN 1 WHEN asking_cents > 1.15 * fair_cents THEN -10 ELSE 0 END AS p8, CASE WHEN n >= 8 THEN 5 WHEN n >= 4 THEN 2 ELSE -2 END AS p9 FROM u),
sc AS (SELECT *, least(100, greatest(0, 50 + coalesce(p1, 0) + p2 + coalesce(p3, 0) + coalesce(p4, 0) + coalesce(p5, 0) + coalesce(p6, 0) + coalesce(p7, 0) + p8 + p9)) AS score,
array_to_string(list_filter([CASE WHEN p1 IS NULL THEN 'location' END, CASE WHEN p3 IS NULL THEN 'rooms' END, CASE WHEN p4 IS NULL THEN 'floor' END, CASE WHEN p5 IS NULL THEN 'condition' END, CASE WHEN p6 IS NULL THEN 'parking' END, CASE WHEN p7 IS NULL THEN 'building_type' END, CASE WHEN elevator IS NULL THEN 'elevator' END], lambda z: z IS NOT NULL), ',') AS unknown,
CAST((p1 IS NULL) AS INT) + CAST((p3 IS NULL) AS INT) + CAST((p4 IS NULL) AS INT) + CAST((p5 IS NULL) AS INT) + CAST((p6 IS NULL) AS INT) + CAST((p7 IS NULL) AS INT) + CAST((elevator IS NULL) AS INT) AS lacks FROM pt),
lq AS (SELECT *, CASE WHEN score >= 75 THEN 'HIGH' WHEN score >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS level, CAST(round(CAST(10 + 0.35::DOUBLE * vc + 0.25::DOUBLE * quality + 25 * ((9 - lacks) / 9) + 5 * least(n, 8) / 8 AS DECIMAL(28, 10)), 2) AS DOUBLE) AS conf FROM sc),
fs AS (SELECT *, CASE WHEN vc < 40 THEN 4 WHEN vc < 60 THEN 2 ELSE 0 END + CASE WHEN disp > 0.15 THEN 2 WHEN disp > 0.08 THEN 1 ELSE 0 END AS extra FROM lq)
SELECT property_id, CASE vs WHEN 'SUCCESS' THEN 'SUCCESS' ELSE 'INSUFFICIENT_DATA' END AS status, CASE WHEN vs <> 'SUCCESS' THEN 'VALUATION_INSUFFICIENT_DATA' END AS reason, CASE WHEN vs = 'SUCCESS' THEN CAST(score AS BIGINT) END AS liquidity_score, CASE WHEN vs = 'SUCCESS' THEN level END AS liquidity_level,
CASE WHEN vs = 'SUCCESS' THEN conf ELSE 0.0 END AS confidence, CASE WHEN vs = 'SUCCESS' THEN unknown END AS unknown, CASE WHEN vs = 'SUCCESS' THEN CAST((2 * fair_cents * (100 - extra - CASE level WHEN 'HIGH' THEN 8 WHEN 'MEDIUM' THEN 12 ELSE 18 END) + 100) // 200 AS BIGINT) END AS sale_low_cents,
CASE WHEN vs = 'SUCCESS' THEN CAST((2 * fair_cents * (100 - extra - CASE level WHEN 'HIGH' THEN 6 WHEN 'MEDIUM' THEN 9 ELSE 14 END) + 100) // 200 AS BIGINT) END AS sale_base_cents, CASE WHEN vs = 'SUCCESS' THEN CAST((2 * fair_cents * (100 - extra - CASE level WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 7 ELSE 10 END) + 100) // 200 AS BIGINT) END AS sale_high_cents,
CASE WHEN vs = 'SUCCESS' THEN least(conf, vc) ELSE 0.0 END AS sale_confidence FROM fs""")
def liquidity_full(spark: SparkSession, d: str) -> DataFrame:
    """Liquidity and fast-sale values on top of the valuations."""
    targets = properties(spark, d)
    out = liquidity.assessed(targets, valuation.valued(targets, listings(spark, d)))
    return out.drop("factors").withColumns({"liquidity_score": F.col("liquidity_score").cast("long"), "unknown": F.array_join("unknown", ",")})
