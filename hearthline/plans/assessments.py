"""Assessments as whole results: sellers, risk, market features, details of pages, time on the market."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.functions.text import canonical_url
from hearthline.operators import extraction, features, sellers, workflow
from hearthline.plans.registry import cents, load, longs, query
from hearthline.plans.relational import DAYS, LISTING
from hearthline.sources import html

FACTS = """SELECT CAST(p_partkey AS BIGINT) AS property_id, p_partkey % 4 AS cut_count, p_partkey * 7 % 20 AS total_pct, nullif(p_partkey * 11 % 150, 13) AS market_age_days, p_partkey % 3 AS relist_count, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS seller_changes,
p_partkey % 4 = 1 AS owner_present, p_partkey % 2 AS agency_count, CAST(round(p_retailprice * 100) AS BIGINT) AS lowest_price FROM part"""
ANSWERS = """SELECT CAST(l_partkey AS BIGINT) AS property_id, l_orderkey * 10 + l_linenumber AS answer_id, CAST(l_shipdate AS TIMESTAMP) AS completed_at, CASE l_returnflag WHEN 'A' THEN 'LOW' WHEN 'R' THEN 'HIGH' WHEN 'N' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'MEDIUM' ELSE 'UNKNOWN' END END AS motivation,
CAST(l_quantity AS BIGINT) * 2 AS motivation_confidence, CASE l_linestatus WHEN 'O' THEN 'MEDIUM' ELSE 'HIGH' END AS negotiability, CASE WHEN l_linenumber <> 3 THEN CAST(l_quantity AS BIGINT) % 7 * l_linenumber END AS negotiability_confidence,
CASE WHEN l_linenumber > 2 THEN l_linestatus = 'O' END AS cash, CAST(l_quantity AS BIGINT) AS cash_confidence, CASE l_linenumber WHEN 1 THEN 'RELOCATION' WHEN 2 THEN 'INHERITANCE' WHEN 4 THEN 'UNKNOWN' END AS reason, CAST(l_quantity AS BIGINT) AS reason_confidence FROM lineitem"""
CALLS = """SELECT CAST(o_custkey AS BIGINT) AS property_id, CAST(o_orderdate AS TIMESTAMP) AS occurred_at, CAST(o_orderdate AS TIMESTAMP) AS created_at, o_orderkey AS interaction_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'HIGH' WHEN '2' THEN 'MEDIUM' WHEN '3' THEN 'LOW' WHEN '4' THEN 'UNKNOWN' END AS seller_motivation,
CASE o_orderkey % 4 WHEN 0 THEN 'DIVORCE' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'RELOCATION' END AS reason_for_sale, CASE WHEN o_orderkey % 3 > 0 THEN 50000 + o_orderkey % 100 * 1000 END AS lowest_indicated_price, CASE WHEN o_orderkey % 5 < 3 THEN o_orderkey % 2 = 0 END AS cash_preferred FROM orders"""
LEVEL = "CASE {x} WHEN 'LOW' THEN 2000 WHEN 'MEDIUM' THEN 5500 WHEN 'HIGH' THEN 8500 END"
GRADE = "CASE WHEN {x} IS NULL THEN 'UNKNOWN' WHEN {x} >= 7000 THEN 'HIGH' WHEN {x} >= 4500 THEN 'MEDIUM' ELSE 'LOW' END"


def _sql(spark: SparkSession, d: str, text: str, table: str) -> DataFrame:
    load(spark, d, table)[0].createOrReplaceTempView(f"_as_{table}")
    return spark.sql(text.replace(f"FROM {table}", f"FROM _as_{table}"))


@query(f"""WITH f AS ({FACTS}), a AS ({ANSWERS}), k AS ({CALLS}),
s AS (SELECT property_id, sum({LEVEL.format(x="motivation")} * motivation_confidence) AS ms, sum(motivation_confidence) FILTER (motivation <> 'UNKNOWN') AS mc, count(motivation_confidence) FILTER (motivation <> 'UNKNOWN') AS mn, sum({LEVEL.format(x="motivation")}) FILTER (motivation_confidence IS NOT NULL) AS mp,
sum({LEVEL.format(x="negotiability")} * negotiability_confidence) AS ns, sum(negotiability_confidence) AS nc, count(negotiability_confidence) AS nn, sum({LEVEL.format(x="negotiability")}) FILTER (negotiability_confidence IS NOT NULL) AS np,
arg_max(cash, (cash_confidence, completed_at, answer_id)) FILTER (cash IS NOT NULL) AS cash, max(cash_confidence) FILTER (cash IS NOT NULL) AS cash_sure, arg_max(reason, (reason_confidence, completed_at, answer_id)) FILTER (reason <> 'UNKNOWN') AS reason FROM a GROUP BY 1),
l AS (SELECT * FROM k WHERE occurred_at <= TIMESTAMP '2000-06-01' AND coalesce(seller_motivation, reason_for_sale, CAST(lowest_indicated_price AS VARCHAR), CAST(cash_preferred AS VARCHAR)) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY occurred_at DESC, interaction_id DESC) = 1),
j AS (SELECT f.*, s.cash, s.cash_sure, s.reason, l.interaction_id, nullif(l.seller_motivation, 'UNKNOWN') AS hand, nullif(l.reason_for_sale, 'UNKNOWN') AS hand_reason, l.lowest_indicated_price AS low, l.cash_preferred AS hand_cash,
CASE WHEN mn > 0 THEN CASE WHEN mc > 0 THEN (2 * ms + mc) // (2 * mc) ELSE (2 * mp + mn) // (2 * mn) END END AS m, (200 * mc + mn) // nullif(2 * mn, 0) AS mu, CASE WHEN nn > 0 THEN CASE WHEN nc > 0 THEN (2 * ns + nc) // (2 * nc) ELSE (2 * np + nn) // (2 * nn) END END AS n, (200 * nc + nn) // nullif(2 * nn, 0) AS nu,
CASE WHEN cut_count >= 2 AND total_pct >= 10 THEN 8500 WHEN cut_count >= 1 AND total_pct >= 5 THEN 7000 WHEN cut_count >= 1 THEN 5500 ELSE 3000 END AS cuts, CASE WHEN market_age_days IS NULL THEN 5000 WHEN market_age_days >= 120 THEN 7500 WHEN market_age_days >= 60 THEN 6000 WHEN market_age_days >= 30 THEN 4500 ELSE 2500 END AS age, CASE WHEN market_age_days IS NULL THEN 2500 ELSE 7000 END AS ageu,
CASE WHEN relist_count > 0 OR seller_changes > 0 THEN 6500 ELSE 3000 END AS again, CASE WHEN owner_present THEN 6500 WHEN agency_count > 0 THEN 4500 ELSE 5000 END AS kind, CASE WHEN lowest_price > 0 AND low IS NOT NULL THEN CASE WHEN low / lowest_price <= 0.90 THEN 8500 WHEN low / lowest_price <= 0.97 THEN 6500 ELSE 3500 END END AS floor_ FROM f LEFT JOIN s USING (property_id) LEFT JOIN l USING (property_id)),
t AS (SELECT *, 55 + CASE WHEN m IS NULL THEN 0 ELSE 35 END + CASE WHEN hand IS NULL THEN 0 ELSE 10 END AS mw, coalesce(m * 35, 0) + cuts * 30 + age * 15 + again * 10 + coalesce({LEVEL.format(x="hand")} * 10, 0) AS mt, coalesce(CASE WHEN m IS NOT NULL THEN mu * 35 END, 0) + 7000 * 30 + ageu * 15 + 6000 * 10 + CASE WHEN hand IS NULL THEN 0 ELSE 90000 END AS mq,
65 + CASE WHEN n IS NULL THEN 0 ELSE 35 END + CASE WHEN floor_ IS NULL THEN 0 ELSE 20 END AS nw, coalesce(n * 35, 0) + cuts * 35 + age * 15 + kind * 15 + coalesce(floor_ * 20, 0) AS nt, coalesce(CASE WHEN n IS NOT NULL THEN nu * 35 END, 0) + 7000 * 35 + ageu * 15 + 5500 * 15 + CASE WHEN floor_ IS NULL THEN 0 ELSE 150000 END AS nq FROM j),
u AS (SELECT *, (2 * mt + mw) // (2 * mw) AS mscore, (2 * mq * (7000 + 30 * least(mw, 100)) + mw * 10000) // (2 * mw * 10000) AS msure, (2 * nt + nw) // (2 * nw) AS nscore, (2 * nq * (7000 + 30 * least(nw, 100)) + nw * 10000) // (2 * nw * 10000) AS nsure FROM t)
SELECT property_id, coalesce(hand, {GRADE.format(x="mscore")}) AS motivation_level, CAST(CASE WHEN hand IS NOT NULL THEN {LEVEL.format(x="hand")} ELSE mscore END AS BIGINT) AS motivation_score, CAST(CASE WHEN hand IS NOT NULL THEN 9000 ELSE msure END AS BIGINT) AS motivation_confidence, {GRADE.format(x="nscore")} AS negotiability_level, CAST(nscore AS BIGINT) AS negotiability_score, CAST(nsure AS BIGINT) AS negotiability_confidence,
CASE WHEN hand_cash IS NOT NULL THEN hand_cash ELSE cash END AS cash_preferred, CAST(CASE WHEN hand_cash IS NOT NULL THEN 9000 ELSE 100 * cash_sure END AS BIGINT) AS cash_confidence, coalesce(hand_reason, reason, 'UNKNOWN') AS reason_for_sale,
concat_ws(',', CASE WHEN hand IS NOT NULL THEN 'seller_motivation' END, CASE WHEN hand_cash IS NOT NULL THEN 'cash_preference' END, CASE WHEN hand_reason IS NOT NULL THEN 'reason_for_sale' END) AS manual_precedence FROM u""")
def seller_full(spark: SparkSession, d: str) -> DataFrame:
    """Sellers from facts, extracted answers and the last call, with manual answers first."""
    out = sellers.assessed(_sql(spark, d, FACTS, "part"), _sql(spark, d, ANSWERS, "lineitem"), _sql(spark, d, CALLS, "orders"), F.lit("2000-06-01").cast("timestamp"))
    return out.withColumn("manual_precedence", F.array_join("manual_precedence", ","))


CLAIMS = """SELECT CAST(l_partkey AS BIGINT) AS property_id, CASE l_linenumber % 5 WHEN 0 THEN 'active_dispute' WHEN 1 THEN 'OWNERSHIP_UNKNOWN' WHEN 2 THEN 'GROUND_FLOOR' WHEN 3 THEN 'NEW_THING' ELSE '' END AS code, CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'R' THEN 'LOW' END AS severity, CAST(l_quantity AS BIGINT) * 2 AS confidence, l_orderkey AS answer FROM lineitem"""


@query(f"""WITH c AS (SELECT property_id, upper(code) AS code, severity, confidence, answer FROM ({CLAIMS}) WHERE code <> ''),
k AS (SELECT property_id, code, CASE WHEN code = 'NEW_THING' THEN 'INFO' WHEN severity IS NOT NULL THEN upper(severity) WHEN code = 'ACTIVE_DISPUTE' THEN 'CRITICAL' WHEN code = 'OWNERSHIP_UNKNOWN' THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE WHEN code = 'ACTIVE_DISPUTE' AND confidence >= 75 THEN 'BLOCK' WHEN code IN ('ACTIVE_DISPUTE', 'OWNERSHIP_UNKNOWN') THEN 'VERIFY' ELSE 'NONE' END AS effect, least(confidence, 100) AS confidence, 'LLM' AS kind, CAST(answer AS VARCHAR) AS ref FROM c),
s AS (SELECT p_partkey AS property_id, f.* FROM part, LATERAL (VALUES ('GROUND_FLOOR', 'LOW', 'NONE', 65, 'DERIVED', 'effective_property_data.floor', p_partkey % 9 = 0), ('HIGH_FLOOR_NO_ELEVATOR', 'MEDIUM', 'NONE', 65, 'DERIVED', 'effective_property_data.floor_elevator', p_partkey % 9 >= 7 AND p_partkey % 2 = 0), ('POOR_PARKING', 'LOW', 'NONE', 65, 'DERIVED', 'effective_property_data.parking', p_partkey % 4 = 0),
('MAJOR_RENOVATION', 'HIGH', 'NONE', 65, 'DERIVED', 'effective_property_data.condition_category', p_partkey % 6 = 0)) AS f(code, severity, effect, confidence, kind, ref, hit) WHERE hit),
m AS (SELECT p_partkey AS property_id, f.* FROM part, LATERAL (VALUES ('UNREGISTERED_OR_UNCLEAR', 'HIGH', 'VERIFY', 75, 'MANUAL', p_partkey % 7 = 0), ('MORTGAGE_CLAIMED', 'MEDIUM', 'VERIFY', 70, 'MANUAL', p_partkey % 10 = 0)) AS f(code, severity, effect, confidence, kind, hit) WHERE hit),
z AS (SELECT property_id, unnest(['GROUND_FLOOR', 'ACTIVE_DISPUTE']) AS code FROM m),
a AS (SELECT property_id, code, severity, effect, confidence, kind, ref FROM k UNION ALL SELECT property_id, code, severity, effect, confidence, kind, ref FROM s), b AS (SELECT a.* FROM a ANTI JOIN z USING (property_id, code) UNION ALL SELECT property_id, code, severity, effect, confidence, kind, 'call' FROM m),
g AS (SELECT property_id, code, effect, kind, ref, max({{'c': confidence, 's': severity}}) AS x FROM b GROUP BY ALL),
h AS (SELECT property_id, count(*) AS n, bool_or(effect = 'BLOCK') AS blocks, bool_or(effect = 'VERIFY') AS verifies, max(CASE x.s WHEN 'INFO' THEN 5 WHEN 'LOW' THEN 20 WHEN 'MEDIUM' THEN 45 WHEN 'HIGH' THEN 70 WHEN 'CRITICAL' THEN 95 END) AS worst, max(x.c) AS sure FROM g GROUP BY 1)
SELECT property_id, n AS flags, CASE WHEN blocks THEN 'BLOCK' WHEN verifies THEN 'VERIFY' ELSE 'PASS' END AS gate, CAST(CASE WHEN blocks THEN greatest(worst, 90) ELSE worst END AS BIGINT) AS risk_score, CAST(sure AS BIGINT) AS confidence FROM h""")
def risk_full(spark: SparkSession, d: str) -> DataFrame:
    """Flags of claims, of soft facts and of calls, suppressed and made distinct, and the gate of each property."""
    (part,) = load(spark, d, "part")
    c, k = F.col, F.col("p_partkey")
    item = F.struct(F.struct(c("code"), c("severity"), c("confidence").cast("double").alias("confidence")).alias("x"))
    answers = _sql(spark, d, CLAIMS, "lineitem").select(F.concat_ws(":", "property_id", "answer").alias("key"), F.lit("SUCCESS").alias("status"), F.to_json(F.struct(F.array(item["x"]).alias("legal_claims"))).alias("answer"))
    fields = ["code", "severity", "effect", "confidence", "source_kind", "source_reference"]
    said = extraction.claims(answers, "key").select(F.split("key", ":")[0].cast("long").alias("property_id"), *fields[:5], F.split("source_reference", ":")[1].alias("source_reference"))
    condition = F.when(k % 6 == 0, "MAJOR_RENOVATION")
    soft = part.select(k.cast("long").alias("property_id"), F.explode(sellers.soft_flags((k % 9).cast("int"), k % 2 != 0, k % 4 != 0, F.lower(condition))).alias("f")).select("property_id", "f.*")
    called = part.select(k.cast("long").alias("property_id"), F.explode(sellers.call_flags(k % 7 != 0, F.lit(None).cast("boolean"), k % 10 == 0, F.lit(None).cast("boolean"), F.lit("call"))).alias("f"))
    manual = called.select("property_id", "f.*", F.array(F.lit("ground_floor"), F.lit("ACTIVE_DISPUTE")).alias("suppresses"))
    kept = sellers.distinct_flags(sellers.unsuppressed(said.unionByName(soft).select("property_id", *fields), manual))
    each = kept.groupBy("property_id").agg(F.collect_list(F.struct(*fields)).alias("flags"))
    status, score, sure = sellers.gate(c("flags"))
    return longs(each.select("property_id", F.size("flags").alias("n"), status.alias("gate"), score.alias("risk_score"), sure.alias("confidence")), "n", "risk_score", "confidence").withColumnRenamed("n", "flags")


CUTS = "SELECT l_partkey AS property_id, CAST(l_shipdate AS TIMESTAMP) AS at, l_orderkey * 10 + l_linenumber AS event_id, CAST(round(l_extendedprice * 100) AS BIGINT) AS old_price, CAST(round(l_extendedprice * (100 - l_linenumber * 3)) AS BIGINT) AS new_price FROM lineitem"


@query(f"""WITH t AS ({LISTING}), p AS (SELECT property_id, count(*) FILTER (status = 'ACTIVE') AS active_count, count(*) AS known_count, min(price) FILTER (status = 'ACTIVE' AND price > 0) AS lowest_price, max(price) FILTER (status = 'ACTIVE' AND price > 0) AS highest_price, {DAYS.format(x="coalesce(max(first_seen) FILTER (status = 'ACTIVE'), max(first_seen))")} AS listing_age_days,
{DAYS.format(x="min(first_seen)")} AS market_age_days, greatest(count(*) - 1, 0) AS relist_count, coalesce(bool_or(status = 'ACTIVE' AND seller = 'OWNER'), false) AS owner_present, count(*) FILTER (status = 'ACTIVE' AND seller = 'AGENCY') AS agency_count FROM t GROUP BY 1),
c AS (SELECT *, ((old_price - new_price) * 2000000 + old_price) // (2 * old_price) AS e4 FROM ({CUTS.replace(' AS at,', ' AS seen,')}) WHERE new_price < old_price),
k AS (SELECT property_id, count(*) AS cut_count, arg_min(old_price, (seen, event_id)) AS o, min(new_price) AS n, arg_min(old_price, (seen, event_id)) FILTER (seen >= TIMESTAMP '2001-12-02') AS o30, min(new_price) FILTER (seen >= TIMESTAMP '2001-12-02') AS n30, max(e4) AS largest, max(seen) AS last_cut FROM c GROUP BY 1)
SELECT property_id, active_count, known_count, lowest_price, highest_price, listing_age_days, market_age_days, relist_count, owner_present, agency_count, coalesce(cut_count, 0) AS cut_count, coalesce(CASE WHEN n < o THEN ((o - n) * 2000000 + o) // (2 * o) END, 0) AS total_e4, coalesce(CASE WHEN n30 < o30 THEN ((o30 - n30) * 2000000 + o30) // (2 * o30) END, 0) AS total_30d_e4, largest AS largest_e4, {DAYS.format(x="last_cut")} AS days_since_cut FROM p LEFT JOIN k USING (property_id)""")
def features_full(spark: SparkSession, d: str) -> DataFrame:
    """The market features of every property: listings, ages, relists, sellers and price cuts."""
    listings = _sql(spark, d, LISTING, "lineitem").withColumn("size", F.lit(None).cast("double"))
    out = features.market_features(listings, _sql(spark, d, CUTS, "lineitem"), F.lit("2002-01-01").cast("timestamp"))
    e4 = lambda name: F.round(F.col(name) * 10_000).cast("long")
    out = out.withColumns({"total_e4": e4("total_pct"), "total_30d_e4": e4("pct_30d"), "largest_e4": e4("largest_pct")}).drop("total_pct", "pct_30d", "largest_pct", "pct_7d", "price_per_m2")
    return longs(out, "listing_age_days", "market_age_days", "days_since_cut", "cut_count")


@query("""WITH p AS (SELECT page_id, url, replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)', 1), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS base FROM pages WHERE url IS NOT NULL)
SELECT page_id, lpad(CAST(page_id AS VARCHAR), 24, '0') AS external_id, concat(base, '/', lpad(CAST(page_id AS VARCHAR), 24, '0')) AS url, CASE WHEN page_id % 3 > 0 THEN nullif(trim(title), '') ELSE 'Meta & title' END AS title_raw, CASE WHEN page_id % 2 = 0 THEN 'Stan na 3. spratu' ELSE 'Bez opisa' END AS description_raw, CASE WHEN page_id % 2 = 0 THEN 'na 3. spratu' END AS floor_raw,
CAST(page_id * 1000 AS VARCHAR) AS price_raw, CASE WHEN page_id % 5 > 0 THEN 'EUR' END AS currency_raw, CAST(page_id % 90 AS VARCHAR) AS size_raw, 'Ulica 1, Beograd' AS location_raw, CASE WHEN page_id % 4 = 0 THEN 'Agencija' END AS agency_raw, 'Agencija' AS seller_raw, CAST(page_id % 3 AS BIGINT) AS images, len(regexp_extract_all(html, 'href="([^"]*)"')) AS links FROM p JOIN pages USING (page_id)""")
def details_full(spark: SparkSession, d: str) -> DataFrame:
    """Detail records of the pages, each with the JSON-LD of a listing put into its own html."""
    (pages,) = load(spark, d, "pages")
    c, k, lit = F.col, F.col("page_id"), F.lit
    told = pages.filter("url is not null").withColumn("at", F.concat(canonical_url(c("url")), lit("/"), F.lpad(k.cast("string"), 24, "0"))).withColumn("title", html.title(c("html")))
    item = lambda kind, **fields: F.struct(lit(kind).alias("@type"), *(v.alias(n) for n, v in fields.items()))
    listing = item("RealEstateListing", name=F.when(k % 3 > 0, c("title")), url=c("at"), description=F.when(k % 2 == 0, "Stan na 3. spratu").otherwise("Bez opisa"))
    flat = item("Apartment", area=F.struct((k % 90).cast("string").alias("value")), address=F.struct(lit("Ulica 1").alias("streetAddress"), lit("Beograd").alias("addressLocality")), image=F.slice(F.array(*(F.struct(lit(f"http://i/{n}").alias("url")) for n in range(2))), 1, (k % 3).cast("int")))
    offer = item("Offer", price=(k * 1000).cast("string"), priceCurrency=F.when(k % 5 > 0, "EUR"))
    seller = F.struct(F.when(k % 4 == 0, "Organization").otherwise("Person").alias("@type"), lit("x#seller").alias("@id"), lit("Agencija").alias("name"))
    graph = F.concat(lit('<script type="application/ld+json">{"@graph":['), F.concat_ws(",", *(F.to_json(x) for x in (listing, flat, offer, seller))), lit("]}</script>"))
    page = told.select("page_id", "url", F.concat(lit('<meta property="og:title" content="Meta &amp; title">'), graph, lit('<script type="application/ld+json">{bad</script>'), "html").alias("html"))
    found = html.details(page, "page_id").join(page.select("page_id", F.size(html.links(c("html"))).cast("long").alias("links")), "page_id")
    return found.select("page_id", "external_id", "url", "title_raw", "description_raw", "floor_raw", "price_raw", "currency_raw", "size_raw", "location_raw", "agency_raw", "seller_raw", F.size("image_urls").cast("long").alias("images"), "links")


@query("""WITH l AS (SELECT l_partkey AS property_id, l_orderkey * 10 + l_linenumber AS listing_id, CAST(l_shipdate AS TIMESTAMP) AS first_seen, CAST(l_shipdate AS TIMESTAMP) + to_days(CAST(l_quantity AS INT)) AS last_seen FROM lineitem),
r AS (SELECT *, max(last_seen) OVER (PARTITION BY property_id ORDER BY first_seen, last_seen, listing_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM l),
s AS (SELECT *, sum(CASE WHEN reach IS NULL OR epoch_us(first_seen) - epoch_us(reach) > 2592000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY property_id ORDER BY first_seen, last_seen, listing_id ROWS UNBOUNDED PRECEDING) AS session FROM r)
SELECT property_id, CAST(session AS BIGINT) AS session, min(first_seen) AS started_at, max(last_seen) AS ended_at, count(*) AS listings FROM s GROUP BY ALL""")
def relist_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each property's time on the market in sessions."""
    rows = _sql(spark, d, "SELECT l_partkey AS property_id, l_orderkey * 10 + l_linenumber AS listing_id, CAST(l_shipdate AS TIMESTAMP) AS first_seen, CAST(l_shipdate AS TIMESTAMP) + make_dt_interval(CAST(l_quantity AS INT)) AS last_seen FROM lineitem", "lineitem")
    return workflow.relist_sessions(rows, "property_id")


@query("""WITH p AS (SELECT p_partkey AS property_id, CASE WHEN p_partkey % 3 > 0 THEN CASE WHEN p_partkey % 4 = 0 THEN 'STALE' WHEN p_partkey % 5 = 0 THEN 'FAILED' ELSE 'SUCCESS' END ELSE 'NOT_RUN' END AS v, CASE WHEN p_partkey % 2 = 0 THEN 'INSUFFICIENT_DATA' ELSE 'SUCCESS' END AS x FROM part),
e AS (SELECT l_partkey AS property_id, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag IN ('R', 'A')) AS r FROM lineitem GROUP BY 1)
SELECT p.property_id, v AS valuation_status, CASE WHEN coalesce(r, FALSE) THEN 'STALE' ELSE x END AS deal_status, CASE WHEN coalesce(a, FALSE) THEN 'STALE' ELSE 'NOT_RUN' END AS risk_status, 'NOT_RUN' AS llm_status FROM p LEFT JOIN e USING (property_id)""")
def module_states(spark: SparkSession, d: str) -> DataFrame:
    """States of modules from their latest rows, then marked stale by what events invalidate."""
    part, lines = load(spark, d, "part", "lineitem")
    k, t = F.col("p_partkey"), lambda n: F.expr(f"TIMESTAMP '2024-01-01' + make_dt_interval({n})")
    row = lambda done, status: part.select(k.cast("long").alias("property_id"), done.alias("done_at"), t("0").alias("input_at"), status.alias("status"))
    latest = {
        "valuation": row(F.when(k % 3 > 0, F.when(k % 4 == 0, t("-1")).otherwise(t("1"))), F.when(k % 5 == 0, "FAILED").otherwise("SUCCESS")),
        "deal": row(t("1"), F.when(k % 2 == 0, "INSUFFICIENT_DATA").otherwise("SUCCESS")),
    }
    states = workflow.initial_states(part.select(k.cast("long").alias("property_id")), latest)
    kind = F.when(F.col("l_returnflag") == "A", "SELLER_CHANGED").when(F.col("l_returnflag") == "R", "PRICE_CHANGED")
    marks = lines.select(F.col("l_partkey").cast("long").alias("property_id"), F.explode(workflow.stale_modules(kind)).alias("module"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("error"))
    out = workflow.marked(states, marks, "STALE", t("2"))
    return out.select("property_id", "valuation_status", "deal_status", "risk_status", "llm_status")
