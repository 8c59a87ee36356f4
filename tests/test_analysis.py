"""Valuation, liquidity, risk, resolution, change capture and decisions on small tables with known answers."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from hearthline.functions import text
from hearthline.functions.numbers import haversine_m
from hearthline.operators import changes, extraction, features, liquidity, matching, opportunity, rows, sellers, valuation, workflow
from hearthline.sources import html

NOW = dt.datetime(2024, 6, 1)
days = lambda n: NOW - dt.timedelta(days=n)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("raw", ["m² ąęő ﬁ １２", "Đorđe Žižić", "½ Ǆ … ™", "plain", "ＡＢＣ ß", "é" * 3, ""])
def test_fold_is_the_compatibility_decomposition(spark, raw):
    want = unicodedata.normalize("NFKD", raw.lower()).encode("ascii", "ignore").decode()
    assert one(spark, text.ascii_fold(F.lit(raw))) == want
    assert one(spark, text.folded_tokens(F.lit(f"{raw} x-{raw}"))) == one(spark, text.token_set(text.ascii_fold(F.lit(f"{raw} x-{raw}"))))


def test_located(spark):
    got = one(spark, text.located(F.lit("Novi Beograd - Blok 45"), F.lit(None).cast("string")))
    assert (got.country, got.city, got.municipality, got.neighborhood, got.micro_location, got.precision) == ("RS", "Beograd", "Novi Beograd", "Blok 45", "Blok 45", "MICROZONE")
    got = one(spark, text.located(F.lit("Zemun, Glavna 5")))
    assert (got.neighborhood, got.micro_location, got.precision) == (None, "Zemun, Glavna 5", "MUNICIPALITY")
    assert one(spark, text.located(F.lit("Nis centar"))).micro_location is None


def test_canonical_json(spark):
    value = {"b": 'q"\\é', "a": None, "c": "😀\n"}
    got = one(spark, text.canonical_json({k: F.lit(v).cast("string") for k, v in value.items()}))
    assert got == json.dumps(value, sort_keys=True, separators=(",", ":"))
    assert one(spark, text.canonical_json({"x": F.array(F.lit("é"), F.lit("z"))}, lists={"x"}, spaced=True)) == json.dumps({"x": ["é", "z"]})


# Points of the severities.
@pytest.mark.parametrize(("severity", "points"), [("INFO", 5), ("LOW", 20), ("MEDIUM", 45), ("HIGH", 70), ("CRITICAL", 95)])
def test_severities(spark, severity, points):
    _, score, _ = sellers.gate(F.array(sellers.flag("X", severity, "NONE", 50)))
    assert one(spark, score) == points


def test_legal_and_soft_flags(spark):
    codes = lambda flags: {(f.code, f.severity, f.effect) for f in one(spark, flags)}
    assert codes(sellers.legal_flags(F.lit("flat is unregistered"))) == {("UNREGISTERED_OR_UNCLEAR", "HIGH", "VERIFY")}
    assert codes(sellers.legal_flags(F.lit(" \t"))) == {("CRITICAL_DOCUMENTATION_UNKNOWN", "HIGH", "VERIFY")}
    assert codes(sellers.legal_flags(F.lit("1/2 udeo"))) == {("PARTIAL_OWNERSHIP", "CRITICAL", "BLOCK")}
    soft = sellers.soft_flags(F.lit(8), F.lit(False), F.lit(False), F.lit("RUIN"))
    assert codes(soft) == {("HIGH_FLOOR_NO_ELEVATOR", "MEDIUM", "NONE"), ("MAJOR_RENOVATION", "HIGH", "NONE"), ("POOR_PARKING", "LOW", "NONE")}
    visit = sellers.visit_flags(F.lit("full"), F.lit(None).cast("double"), F.lit(False), F.lit(3), F.lit(True), F.lit("i1"))
    assert codes(visit) == {("MAJOR_RENOVATION", "HIGH", "VERIFY"), ("HIGH_FLOOR_NO_ELEVATOR", "MEDIUM", "VERIFY"), ("VISIBLE_DEFECTS", "MEDIUM", "VERIFY")}
    call = sellers.call_flags(F.lit(False), F.lit(False), F.lit(True), F.lit(None).cast("boolean"), F.lit("i2"))
    assert codes(call) == {("UNREGISTERED_OR_UNCLEAR", "HIGH", "VERIFY"), ("PARTIAL_OWNERSHIP", "CRITICAL", "VERIFY"), ("MORTGAGE_CLAIMED", "MEDIUM", "VERIFY")}


@pytest.mark.parametrize(("code", "severity", "sure", "want"), [
    ("suspicious_listing", None, 75, ("CRITICAL", "BLOCK")), ("OCCUPIED_PROPERTY", "low", 74.9, ("LOW", "VERIFY")), ("LEGALIZATION_UNCLEAR", "?", 99, ("HIGH", "VERIFY")),
    ("POOR_BUILDING", None, 99, ("MEDIUM", "NONE")), ("ANYTHING", "CRITICAL", 99, ("INFO", "NONE")),
])
def test_claims(spark, code, severity, sure, want):
    answer = json.dumps({"legal_claims": [{"code": code, "severity": severity, "confidence": sure}], "risk_signals": [{"code": "", "confidence": 1}]})
    answers = spark.createDataFrame([(1, "SUCCESS", answer), (2, "FAILED", answer)], "k long, status string, answer string")
    assert [(r.k, r.severity, r.effect) for r in extraction.claims(answers, "k").collect()] == [(1, *want)]


def test_suppression_and_distinct_flags(spark):
    schema = "property_id string, code string, severity string, effect string, confidence int, source_kind string, source_reference string"
    found = spark.createDataFrame([("P", "GROUND_FLOOR", "LOW", "NONE", 65, "DERIVED", "f"), ("P", "GROUND_FLOOR", "LOW", "NONE", 90, "VERIFIED_MANUAL", "v"), ("Q", "GROUND_FLOOR", "LOW", "NONE", 65, "DERIVED", "f"), ("Q", "GROUND_FLOOR", "LOW", "NONE", 60, "DERIVED", "f")], schema)
    manual = spark.createDataFrame([("P", "OK", "INFO", "NONE", 70, "MANUAL", "m", ["ground_floor"]), ("Q", "OK", "INFO", "NONE", 69, "MANUAL", "m", ["GROUND_FLOOR"])], schema + ", suppresses array<string>")
    left = sellers.unsuppressed(found, manual)
    assert sorted((r.property_id, r.code, r.source_kind) for r in left.collect()) == [("P", "GROUND_FLOOR", "VERIFIED_MANUAL"), ("P", "OK", "MANUAL"), ("Q", "GROUND_FLOOR", "DERIVED"), ("Q", "GROUND_FLOOR", "DERIVED"), ("Q", "OK", "MANUAL")]
    assert {r.confidence for r in sellers.distinct_flags(left).collect() if r.property_id == "Q" and r.code == "GROUND_FLOOR"} == {65}


def test_latest_call(spark):
    calls = spark.createDataFrame([("P", "i1", days(9), days(9), "HIGH", None, None, None), ("P", "i2", days(5), days(5), None, None, None, None), ("P", "i3", days(-1), days(-1), "LOW", None, None, True)],
                                  "property_id string, interaction_id string, occurred_at timestamp, created_at timestamp, seller_motivation string, reason_for_sale string, lowest_indicated_price double, cash_preferred boolean")
    got = sellers.latest_call(calls, F.lit(NOW)).first()
    assert (got.interaction_id, got.seller_motivation, got.seller_motivation_confidence, got.cash_preferred_confidence) == ("i1", "HIGH", 90, None)


FACTS = "size double, rooms double, floor int, elevator boolean, parking boolean, condition string, building string, year int, heating string, micro string, neighborhood string, municipality string, city string"
FLAT = (50.0, 2.0, 3, True, True, "GOOD", "new", 2000, "gas", "Blok 45", None, "Novi Beograd", "Beograd")


def target(spark, *given):
    rows_ = [(*(("P", "APARTMENT") if len(g) < 2 else g[:2]), *FLAT, "MICROZONE", None, None, 80) if isinstance(g, tuple) else g for g in given]
    return spark.createDataFrame(rows_, f"property_id string, property_type string, {FACTS}, precision string, lat double, lon double, quality long")


def comps(spark, *prices, age=10, city="Beograd", raw=None):
    out = [(k, f"C{k}", p * 100, age, raw, None, None, None, *FLAT[:-1], city) for k, p in enumerate(prices)]
    return spark.createDataFrame(out, f"listing_id long, property_id string, price_cents long, age_days int, city_raw string, location_raw string, lat double, lon double, {FACTS}")


def test_valuation_succeeds_by_city(spark):
    got = valuation.valued(target(spark, ()), comps(spark, 100_000, 100_000, 110_000, 120_000)).first()
    assert (got.status, got.reason, got.included_count, got.radius_m) == ("SUCCESS", None, 4, None)
    assert got.base_m2 == 200_000 and got.fair_cents == 10_000_000 and got.low_cents < got.fair_cents < got.high_cents


@pytest.mark.parametrize(("city", "raw", "n"), [("Nis", None, 0), (None, "stan u BEOGRADU", 4), ("Beograd", None, 4), (None, None, 0)])
def test_comparables_match_the_city_by_property_or_text(spark, city, raw, n):
    got = valuation.valued(target(spark, ()), comps(spark, *[100_000] * 4, city=city, raw=raw)).first()
    assert got.candidate_count == n and got.status == ("SUCCESS" if n else "INSUFFICIENT_DATA")


@pytest.mark.parametrize(("most_pairs", "most_rows"), [(50_000_000, 200_000), (40, 7)])
def test_best_pairs_hold_what_all_pairs_rank(spark, most_pairs, most_rows):
    """The comparables of all pairs, made by a cross join, are those of the pairs that blocks keep, also where they are cut."""
    rnd = random.Random(7)
    one = lambda *xs: rnd.choice([None, *xs])
    facts = lambda: [one(1.0, 1.5, 2.5, 4.0), one(0, 1, 3, 8), one(True, False), one(True, False), one("good", "Renovated", "lux", "ruin"), one("new", " New", "old", " "), one(1970, 1985, 2010), one("gas", "GAS ", "wood"), one("Blok 45", "Kej"), one("North", "south "), one("M1", "m1")]
    place = lambda: rnd.choice([(None, None), (44.8 + rnd.randrange(12) / 1000, 20.4 + rnd.randrange(12) / 1000)])
    targets = [(f"P{k}", rnd.choice([40.0, 50.0]), *facts(), one("Beograd", "Nis", ""), *place()) for k in range(40)]
    comps = [(k, one(*(f"P{j}" for j in range(30))), 5_000_000 + rnd.randrange(9) * 100_000, one(5, 5, 100, 200, 400), one("u beogradu", "NIS"), one("Nis centar"), *place(), rnd.choice([38.0, 41.5, 50.0, 60.0, 80.0]), *facts(), one("Beograd", "Nis")) for k in range(400)]
    names = "rooms double, floor int, elevator boolean, parking boolean, condition string, building string, year int, heating string, micro string, neighborhood string, municipality string, city string"
    ts = spark.createDataFrame(targets, f"property_id string, size double, {names}, lat double, lon double")
    cs = spark.createDataFrame(comps, f"listing_id long, property_id string, price_cents long, age_days int, city_raw string, location_raw string, lat double, lon double, size double, {names}")
    c = F.col
    pairs = ts.crossJoin(valuation._renamed(cs)).filter("c_property_id <> property_id and c_size between size * 0.75 and size * 1.25")
    pairs = pairs.filter("city is null or city = '' or c_city = city or lower(coalesce(city_raw, '')) like '%' || lower(city) || '%' or lower(coalesce(location_raw, '')) like '%' || lower(city) || '%'")
    metres = haversine_m(c("lat"), c("lon"), c("lat2"), c("lon2"))
    pairs = pairs.withColumn("distance_m", F.when(c("lat").isNotNull(), F.round(metres, 2))).filter("lat is null or distance_m <= 1200").localCheckpoint()

    def shown(pairs):
        pairs = valuation.compared(pairs)
        near = valuation.adaptive_radius(pairs.filter("distance_m is not null"), "property_id")
        far = pairs.filter("distance_m is null").withColumn("radius_m", F.lit(None).cast("int"))
        return sorted((r.property_id, r.rank, r.listing_id, r.radius_m, r.similarity, r.weight, r.exclusion) for r in valuation.ranked(near.unionByName(far), "property_id", "listing_id").collect())

    rows.ensure_checkpoint_dir(spark)
    got, want = shown(valuation.best_pairs(ts, cs, most_pairs, most_rows)), shown(pairs)
    assert got == want and len({r[3] for r in want}) > 2 and len(want) > 300


def test_valuation_gate(spark):
    cases = {"H": ("HOUSE", 50.0, "Beograd"), "S": ("APARTMENT", None, "Beograd"), "L": ("APARTMENT", 50.0, None), "N": ("APARTMENT", 50.0, "Nis")}
    made = [(k, kind, size, *FLAT[1:9], *([None] * 3), city, "CITY", None, None, 50) for k, (kind, size, city) in cases.items()]
    got = {r.property_id: (r.status, r.reason, r.fair_cents, r.confidence) for r in valuation.valued(target(spark, *map(list, made)), comps(spark, *[100_000] * 5)).collect()}
    bad = lambda reason: ("INSUFFICIENT_DATA", reason, None, 0.0)
    assert got == {"H": bad("UNSUPPORTED_PROPERTY_TYPE"), "S": bad("MISSING_TARGET_SIZE"), "L": bad("MISSING_TARGET_LOCATION"), "N": bad("NOT_ENOUGH_INCLUDED_COMPS")}


def test_leaf_rules_of_unknown_facts(spark):
    none = F.lit(None)
    assert one(spark, valuation.text_score(F.lit(" "), F.lit(" "))) == 0.40
    assert one(spark, valuation.recency(none.cast("int"))) == 0.50
    assert one(spark, valuation.size_score(none.cast("double"), F.lit(5.0))) == 0.0
    near = [F.lit(x) for x in (False, True, True, True)]
    assert one(spark, valuation.location_score(none.cast("double"), near)) == 0.65 and one(spark, valuation.location_score(F.lit(0.0), near)) == 1.0
    pairs = spark.createDataFrame([("P", 0.9, None, 100.0)] * 4 + [("P", 0.9, 10, 1000.0)], "k string, similarity double, age_days int, distance_m double")
    assert {r.radius_m for r in valuation.adaptive_radius(pairs, "k").collect()} == {300}


def test_liquidity(spark):
    made = target(spark, ()).withColumn("asking_cents", F.lit(9_000_000).cast("long"))
    values = valuation.valued(made, comps(spark, *[100_000] * 8))
    got = liquidity.assessed(made, values).first()
    # 50, high-demand place 14, size 12, rooms 6, floor 6, condition 6, parking 3, building 4, asking below value 3, eight comparables 5: over 100.
    assert (got.status, got.liquidity_score, got.liquidity_level, got.unknown) == ("SUCCESS", 100, "HIGH", [])
    assert got.sale_base_cents == 9_400_000 and got.sale_low_cents < got.sale_base_cents < got.sale_high_cents
    missing = liquidity.assessed(made, values.limit(0)).first()
    assert (missing.status, missing.reason, missing.liquidity_score, missing.confidence) == ("INSUFFICIENT_DATA", "MISSING_SUCCESSFUL_VALUATION", None, 0.0)
    failed = liquidity.assessed(made, valuation.valued(made, comps(spark, 1))).first()
    assert failed.reason == "VALUATION_INSUFFICIENT_DATA" and failed.sale_base_cents is None
    with pytest.raises(ValueError):
        liquidity.assessed(made, values, 0)


def test_liquidity_leaf_rules(spark):
    none = F.lit(None).cast("string")
    assert one(spark, liquidity.size_points(F.lit("HOUSE"), F.lit(50))) == 0
    assert one(spark, liquidity.location_points(F.lit(" "), none, F.lit("Zemun"), none)) == -8
    assert one(spark, liquidity.building_points(F.lit("Suteren"))) == -4
    _, _, unknown = liquidity.assess({"floor": F.lit(None).cast("int"), "rooms": F.lit(6)}, {"elevator": F.lit(None).cast("boolean")})
    assert one(spark, unknown) == ["floor", "elevator"]


LISTING = "listing_id long, tokens array<string>, words array<string>, size double, rooms double, floor int, linked_property_id long, manual boolean"
PROPERTY = "property_id long, p_tokens array<string>, p_size double, p_rooms double, p_floor int"


def test_resolution_states(spark):
    here = ["blok", "45"]
    flat = (here, here, 50.0, 2.0, 3)
    ls = spark.createDataFrame([(1, *flat, None, None), (2, *flat, 77, False), (3, *flat, 77, True), (4, here, here, None, None, None, None, None), (5, here, here, 50.0, 2.0, None, None, None)], LISTING)
    ps = spark.createDataFrame([(10, here, 50.0, 2.0, 3), (11, here, None, None, None)], PROPERTY)
    got = {r.listing_id: (r.action, r.property_id) for r in matching.resolve(ls, ps).collect()}
    assert got == {1: ("AUTO_MATCH", 10), 2: ("EXISTING_LINK", 77), 3: ("MANUAL_PRESERVED", 77), 4: ("NEW_PROPERTY", None), 5: ("POSSIBLE_MATCH", 10)}
    turned_down = spark.createDataFrame([(1, 10), (5, 10)], "listing_id long, property_id long")
    again = {r.listing_id: (r.action, r.property_id) for r in matching.resolve(ls, ps, turned_down).collect()}
    assert again[1] == ("POSSIBLE_MATCH", 11) and again[5] == ("POSSIBLE_MATCH", 11)
    counts = matching.summary(matching.resolve(ls, ps)).first()
    assert (counts.processed, counts.auto_matched, counts.possible_matches, counts.new_properties, counts.existing_links, counts.manual_preserved) == (5, 1, 1, 1, 1, 1)


def test_manual_choices(spark):
    ls = spark.createDataFrame([(1, None, None), (2, 7, False)], "listing_id long, linked_property_id long, manual boolean")
    choices = spark.createDataFrame([(1, 9, days(2)), (1, 8, days(1))], "listing_id long, property_id long, chosen_at timestamp")
    assert {(r.listing_id, r.linked_property_id, r.manual) for r in matching.manually_matched(ls, choices).collect()} == {(1, 8, True), (2, 7, False)}
    pending = spark.createDataFrame([(1, 8, "PENDING", None), (2, 8, "PENDING", None)], "listing_id long, property_id long, status string, resolved_at timestamp")
    judged = matching.judged_candidates(pending, choices.withColumn("accepted", F.lit(False)))
    assert {(r.listing_id, r.status) for r in judged.collect()} == {(1, "REJECTED"), (2, "PENDING")}


def test_first_come_of_a_long_chain(spark):
    """More rounds than any bound: each waits for the one before it, and joins it if that is an owner."""
    nodes = spark.createDataFrame([(k,) for k in range(24)], "node long")
    edges = spark.createDataFrame([(k, k - 1, 0.9) for k in range(1, 24)], "node long, earlier long, similarity double")
    assert {r.node: r.owner for r in matching.first_come(nodes, edges).collect()} == {k: k - k % 2 for k in range(24)}


def test_radius_pairs_across_borders(spark):
    left = spark.createDataFrame([(1, 10.0, 179.9999), (2, 89.9995, 0.0), (3, 0.0, 0.0), (4, -44.8, 20.0)], "id long, lat double, lon double")
    right = spark.createDataFrame([(1, 10.0, -179.9999), (2, 89.9995, 180.0), (3, 0.001, -0.001), (4, -44.8, 20.0126), (5, -44.8, 20.02)], "id2 long, lat2 double, lon2 double")
    assert {(r.id, r.id2) for r in rows.radius_pairs(left, right, 1000).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4)}


def test_radius_pairs_against_all_pairs(spark):
    import random

    draw = random.Random(6)
    points = [(k, 60 + draw.random() * 0.2, draw.random() * 0.4) for k in range(150)]
    left = spark.createDataFrame(points, "id long, lat double, lon double")
    right = spark.createDataFrame([(k + 1000, a + 0.001, b - 0.001) for k, a, b in points], "id2 long, lat2 double, lon2 double")
    from hearthline.functions.numbers import haversine_m

    want = left.crossJoin(right).filter(haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= 1500)
    pairs = lambda df: sorted((r.id, r.id2) for r in df.collect())
    assert pairs(rows.radius_pairs(left, right, 1500)) == pairs(want) != []


FIELDS = "title string, description string, size double, city_raw string, location_raw string, rooms double, floor int, total_floors int, seller_name string, agency_name string"


def test_upsert(spark):
    text_of = lambda t: (t, *[None] * 9)
    old = spark.createDataFrame([(1, *text_of("old"), 100.0, "EUR", 2.0, "OWNER", "REMOVED", 3, days(9), days(5), days(4), days(5)), (2, *text_of("kept"), 50.0, "EUR", 1.0, "UNKNOWN", "ACTIVE", 0, days(9), days(1), None, None)],
                                f"k long, {FIELDS}, price double, currency string, price_per_m2 double, seller_type string, status string, misses int, first_seen timestamp, last_seen timestamp, removed_at timestamp, last_detail_at timestamp")
    new = spark.createDataFrame([(1, *text_of(None), None, "RSD", None, "UNKNOWN", False), (3, *text_of("new"), None, None, None, "AGENCY", True)], f"k long, {FIELDS}, price double, currency string, price_per_m2 double, seller_type string, detailed boolean")
    got = {r.k: r for r in changes.upserted(old, new, "k", F.lit(NOW)).collect()}
    assert (got[1].title, got[1].price, got[1].currency, got[1].seller_type, got[1].status, got[1].misses, got[1].removed_at, got[1].first_seen, got[1].last_seen, got[1].last_detail_at) == ("old", 100.0, "EUR", "OWNER", "ACTIVE", 0, None, days(9), NOW, days(5))
    assert (got[2].title, got[2].status, got[2].last_seen) == ("kept", "ACTIVE", days(1))
    assert (got[3].title, got[3].price, got[3].first_seen, got[3].last_detail_at, got[3].seller_type) == ("new", None, NOW, NOW, "AGENCY")


def test_health(spark):
    health = lambda *a: one(spark, changes.source_health(*map(F.lit, a)))
    assert [health("SUCCESS", 0, 0, False), health("SUCCESS", 1, 0), health("SUCCESS", 0, 2), health("SUCCESS", 0, 0, True), health("PARTIAL"), health("FAILED", 1)] == ["HEALTHY", "DEGRADED", "DEGRADED", "DEGRADED", "DEGRADED", "FAILED"]


def test_listing_context(spark):
    ls = spark.createDataFrame([("P", 1, "ACTIVE", 90.0, days(2)), ("P", 2, "ACTIVE", None, days(1)), ("Q", 3, "ACTIVE", 10.0, days(30)), ("R", 4, "REMOVED", 1.0, days(1))], "property_id string, listing_id long, status string, price double, first_seen timestamp")
    ev = spark.createDataFrame([("Q", 1, "PRICE_CHANGED", days(3), 100.0, 94.5), ("Q", 2, "PRICE_CHANGED", days(20), 200.0, 100.0)], "property_id string, event_id long, event_type string, detected_at timestamp, old_price double, new_price double")
    got = {r.property_id: (r.active_listing_id, r.signals, r.last_change) for r in opportunity.listing_context(ls, ev, F.lit(NOW)).collect()}
    assert got == {"P": (1, ["NEW_LISTING"], "New listing"), "Q": (3, ["LARGE_RECENT_PRICE_CUT"], "Price cut 5.5% on 2024-05-29")}


def test_issues(spark):
    names = ["deal_status", "valuation_status", "fast_sale_status", "liquidity_status", "risk_gate", "location"]
    numbers = ["fair_value", "sale_low", "sale_base", "sale_high", "liquidity_score", "size", "asking_price", "max_buy_price", "negotiation_pct", "expected_profit", "downside_profit", "roi"]
    full = {n: F.lit("SUCCESS") for n in names} | {n: F.lit(1.0) for n in numbers} | {"has_investment": F.lit(True), "has_cost": F.lit(True)}
    assert one(spark, opportunity.minimum_data_issues(full)) == []
    bare = {n: F.lit(None).cast("string") for n in names} | {n: F.lit(None).cast("double") for n in numbers} | {"has_investment": F.lit(False), "has_cost": F.lit(False)}
    assert one(spark, opportunity.minimum_data_issues(bare)) == ["MISSING_DEAL_ANALYSIS", "MISSING_INVESTMENT_PROFILE", "MISSING_COST_PROFILE", "MISSING_SUCCESSFUL_VALUATION", "MISSING_SUCCESSFUL_FAST_SALE", "MISSING_SUCCESSFUL_LIQUIDITY", "MISSING_RISK_ASSESSMENT", "MISSING_USABLE_SIZE", "MISSING_USABLE_LOCATION"]
    assert one(spark, opportunity.minimum_data_issues(full | {"roi": F.lit(None).cast("double"), "sale_low": F.lit(0.0)})) == ["MISSING_SUCCESSFUL_FAST_SALE", "MISSING_ROI"]
    assert one(spark, opportunity.economic_issues(F.lit(-1), F.lit(5), F.lit(0.1), F.lit(10), F.lit(None).cast("int"), F.lit(0.2))) == ["NEGATIVE_EXPECTED_PROFIT", "EXPECTED_PROFIT_BELOW_MIN", "ROI_BELOW_MIN"]
    assert one(spark, opportunity.confidence_issues(F.lit(40), F.lit(50), F.lit(None).cast("int"), F.lit(5))) == ["VALUATION_CONFIDENCE_BELOW_MIN", "MISSING_LIQUIDITY_SCORE"]


def test_summary_and_state_hash(spark):
    dec = lambda v: F.lit(v).cast("decimal(14,2)")
    c = {n: dec("150000.50") for n in ("fair_low", "fair_high", "asking_price", "sale_base", "max_buy_price", "expected_profit", "downside_profit")}
    c |= {"property_id": F.lit(7), "location": F.lit("Beograd - Zémun"), "property": opportunity.property_label(dec("50.50"), dec("2.00"), F.lit(3), F.lit(5), F.lit(True)), "roi": F.lit("0.100000"), "negotiation_pct": F.lit(None).cast("string"),
          "liquidity_score": F.lit("70.00"), "valuation_confidence": F.lit("60.00"), "seller_motivation": F.lit(None).cast("string"), "risk_gate": F.lit("PASS"), "market_age_days": F.lit(4), "last_change": F.lit("x"), "signals": F.array(F.lit("NEW_LISTING")), "active_listing_id": F.lit(1)}
    summary = opportunity.decision_summary(c)
    got = one(spark, summary)
    assert (got.asking_price, got.fmv_range, got.property, got.seller_motivation) == ("EUR 150,001", "EUR 150,001-EUR 150,001", "50.5 m2 | 2 rooms | 3/5 | lift", "UNKNOWN")
    digest = one(spark, opportunity.state_hash(summary, F.lit(7), F.lit("CALL"), F.array(F.lit("A")), F.lit("66.00"), F.lit("12.0000")))
    told = {n: got[n] for n in opportunity.HASHED}
    payload = {"rules_version": "opportunity_rules_v1", "property_id": "7", "recommended_action": "CALL", "reason_codes": ["A"], "score": "66.00", "ranking_value": "12.0000", "decision_summary": told}
    assert digest == hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert opportunity.location_label(F.lit("A"), F.lit(""), F.lit(None).cast("string"), F.lit("N")) is not None
    assert [opportunity.batch_status(spark.range(n)).first().status for n in (0, 2)] == ["NO_QUALIFYING_OPPORTUNITIES", "QUALIFYING_OPPORTUNITIES"]


def test_module_states(spark):
    latest = spark.createDataFrame([("P", days(1), days(2), "SUCCESS"), ("Q", days(3), days(2), "SUCCESS")], "property_id string, done_at timestamp, input_at timestamp, status string")
    states = workflow.initial_states(spark.createDataFrame([("P",), ("Q",), ("R",)], "property_id string"), {"deal": latest})
    assert {r.property_id: r.deal_status for r in states.collect()} == {"P": "SUCCESS", "Q": "STALE", "R": "NOT_RUN"}
    marks = spark.createDataFrame([("P", "deal", None, "boom"), ("P", "nonsense", None, None)], "property_id string, module string, status string, error string")
    stale = workflow.marked(states, marks, "STALE", F.lit(NOW))
    assert {(r.property_id, r.deal_status, r.last_error) for r in stale.collect()} == {("P", "STALE", "boom"), ("Q", "STALE", None), ("R", "NOT_RUN", None)}
    assert workflow.unknown_modules(marks).count() == 1 and workflow.modules_with(stale, "STALE").first().n == 2
    done = workflow.marked(stale, marks.withColumn("status", F.lit("FAILED")), "SUCCESS", F.lit(NOW)).filter("property_id = 'P'").first()
    assert (done.deal_status, done.last_error, done.completed_at) == ("FAILED", None, NOW)
    with pytest.raises(ValueError):
        workflow.marked(states, marks, "DONE", F.lit(NOW))


def test_history_and_sessions(spark):
    history = spark.createDataFrame([("A", NOW, "DISCOVERED", "1", None), ("B", NOW, "PRICE_CHANGED", "2", "5")], "key string, at timestamp, kind string, ident string, value string")
    ls = spark.createDataFrame([("A", 1, days(50), days(40)), ("B", 2, days(50), days(40)), ("B", 3, days(30), days(20)), ("B", 4, days(5), days(1))], "key string, listing_id long, first_seen timestamp, last_seen timestamp")
    assert sorted((r.key, r.kind) for r in workflow.with_discovered(history, ls.filter("listing_id < 3")).collect()) == [("A", "DISCOVERED"), ("B", "DISCOVERED"), ("B", "PRICE_CHANGED")]
    got = {(r.key, r.session): r.listings for r in workflow.relist_sessions(ls, "key", 12).collect()}
    assert got == {("A", 1): 1, ("B", 1): 2, ("B", 2): 1}


def test_sort_whitelist(spark):
    fields = {"price": "price_cents"}
    df = spark.createDataFrame([(1, None), (2, 5), (3, 9)], "id long, price_cents long")
    assert [r.id for r in df.orderBy(*rows.sort_order("price", "desc", fields, "id")).collect()] == [3, 2, 1]
    assert [r.id for r in df.orderBy(*rows.sort_order("price", "asc", fields, "id")).collect()] == [2, 3, 1]
    for bad in (("size", "asc"), ("price", "up")):
        with pytest.raises(ValueError):
            rows.sort_order(*bad, fields, "id")


PAGE = """<html><head><title>T</title><meta property="og:title" content="Stan &amp; lift"><meta content='opis' name='description'><meta name="description" content="last"></head>
<script type="application/ld+json">[{"@type": ["Offer", "Thing"], "price": 150000, "priceCurrency": "EUR"}, 5]</script><script type="application/ld+json">{bad</script>
<script type="application/ld+json">{"@graph": [{"@type": "Apartment", "floorSize": {"value": "50,5"}, "numberOfRooms": 2, "image": ["a.jpg", {"contentUrl": "b.jpg"}, {"url": "c.jpg"}], "address": {"streetAddress": "Glavna 5", "addressLocality": "Zemun"}},
{"@id": "x#seller", "@type": "Organization", "name": " Agent "}, {"@type": "RealEstateAgent", "name": "other"}, {"@type": "RealEstateListing", "datePosted": "2024-01-01", "description": "Stan na 5. spratu"}]}</script></html>"""


def test_detail_record(spark):
    pages = spark.createDataFrame([(1, "https://a.b/prodaja/x/0123456789abcdef01234567/?q=1", PAGE), (2, "https://a.b/none", "<html>")], "page_id long, url string, html string")
    (got,) = html.details(pages, "page_id").collect()
    assert got.asDict() == {
        "page_id": 1, "external_id": "0123456789abcdef01234567", "url": "https://a.b/prodaja/x/0123456789abcdef01234567", "title_raw": "Stan & lift", "description_raw": "Stan na 5. spratu", "price_raw": "150000", "currency_raw": "EUR",
        "size_raw": "50,5", "location_raw": "Glavna 5, Zemun", "rooms_raw": "2", "floor_raw": "na 5. spratu", "seller_raw": "Agent", "agency_raw": "Agent", "image_urls": ["a.jpg", "b.jpg", "c.jpg"], "published_raw": "2024-01-01",
    }
    assert pages.select(html.meta(F.col("html")).alias("m")).first().m == {"og:title": "Stan & lift", "description": "last"}


def test_detail_record_of_quotes_escaped_in_a_string(spark):
    """A block whose strings alone are escaped, and one escaped as a whole, both tell their item."""
    url = "http://x/" + "0" * 24
    inner = f'{{"@type":"RealEstateListing","name":"say &quot;hi&quot; &amp; go","url":"{url}"}}'
    whole = f"{{&quot;@type&quot;:&quot;RealEstateListing&quot;,&quot;name&quot;:&quot;plain&quot;,&quot;url&quot;:&quot;{url}&quot;}}"
    page = lambda b: f'<script type="application/ld+json">{b}</script>'
    frame = spark.createDataFrame([(1, "http://y", page(inner)), (2, "http://y", page(whole)), (3, "http://y", page("{bad"))], "page_id long, url string, html string")
    assert {r.page_id: (r.title_raw, r.url) for r in html.details(frame, "page_id").collect()} == {1: ('say "hi" & go', url), 2: ("plain", url)}


def test_article_cards_and_plain_details(spark):
    page = """<main data-listing-id='nkrs-7' data-price="150.000 EUR" data-title=" Stan &amp; lift "><meta name="description" content="opis"><img src='a.jpg'><img alt="x">
    <article class="c" data-listing-id="nkrs-1" data-price='99 EUR' data-size="50"><a href="/oglas/one">x</a></article><article data-url="/oglas/NKRS-2/?q=1"></article><article data-listing-id="NKRS-1"></article><article></article></main>"""
    pages = spark.createDataFrame([(1, "https://n.rs/oglas/x?y", page), (2, "https://n.rs/none", "<p>")], "page_id long, url string, html string")
    got = {r.external_id: (r.url, r.price_raw, r.currency_raw, r.size_raw) for r in html.article_cards(pages, "page_id").collect()}
    assert got == {"NKRS-1": ("/oglas/one", "99 EUR", "99 EUR", "50"), "NKRS-2": ("/oglas/NKRS-2", None, None, None)}
    (d,) = html.plain_details(pages, "page_id").collect()
    assert (d.external_id, d.url, d.title_raw, d.description_raw, d.price_raw, d.currency_raw, d.image_urls) == ("NKRS-7", "https://n.rs/oglas/x", "Stan & lift", "opis", "150.000 EUR", "150.000 EUR", ["a.jpg"])


def test_watch_rules_of_all_kinds(spark):
    rules = [(1, None, None), (2, "ANY_PRICE_CHANGE", None), (3, "PRICE_BELOW", 90.0), (4, "PRICE_DROP_PERCENT", 0.1), (5, "DESCRIPTION_CHANGE", None), (6, "SELLER_CHANGE", None)]
    rf = spark.createDataFrame([("P", *r, True) for r in rules], "property_id string, rule_id long, rule_type string, threshold double, is_active boolean")
    ev = spark.createDataFrame([("P", 1, "PRICE_CHANGED", 100.0, 90.0), ("P", 2, "DESCRIPTION_CHANGED", None, None), ("P", 3, "SELLER_CHANGED", None, None), ("P", 4, "REAPPEARED", None, None), ("P", 5, "PRICE_CHANGED", 90.0, 95.0)], "property_id string, event_id long, event_type string, old_price double, new_price double")
    got = {(r.rule_id, r.event_id): r.change_key for r in workflow.triggers(rf, ev).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3), (1, 5), (2, 1), (2, 5), (3, 1), (4, 1), (5, 2), (6, 3)} and got[1, 2] == "2:DEFAULT:default" and got[3, 1] == "1:PRICE_BELOW:90.0"
    told = one(spark, workflow.what_changed(F.lit("PRICE_CHANGED"), F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(100), F.lit(90), F.lit("WATCH"), F.lit("CALL")))
    assert (told.summary_text, float(told.price_drop_pct), told.action_upgraded, told.trigger_type) == ("Price changed from 100 to 90", 10.0, True, "DEFAULT")
    assert not one(spark, workflow.valid_rule(F.lit("PRICE_BELOW"), F.lit(None).cast("int"))) and one(spark, workflow.valid_rule(F.lit(None).cast("string"), F.lit(None).cast("int")))


def test_market_features(spark):
    ls = spark.createDataFrame([("P", "ACTIVE", 90.0, days(5), "OWNER", 45.0), ("P", "REMOVED", 200.0, days(50), "AGENCY", 45.0)], "property_id string, status string, price double, first_seen timestamp, seller string, size double")
    ev = spark.createDataFrame([("P", days(10), 1, 100.0, 90.0)], "property_id string, at timestamp, event_id long, old_price double, new_price double")
    got = features.market_features(ls, ev, F.lit(NOW)).first()
    assert (got.price_per_m2, got.listing_age_days, got.market_age_days, got.known_count, got.cut_count, got.pct_7d, got.pct_30d, got.days_since_cut, got.owner_present) == (2.0, 5, 50, 2, 1, 0, 10, 10, True)
    assert len(got) == 17
    old = spark.createDataFrame([(1, "v1", 5), (1, "v2", 6), (2, "v1", 7)], "id long, version string, x long")
    new = spark.createDataFrame([(1, "v2", 60), (3, "v2", 8)], "id long, version string, x long")
    assert {tuple(r) for r in features.versioned(old, new, ["id", "version"]).collect()} == {(1, "v1", 5), (2, "v1", 7), (1, "v2", 60), (3, "v2", 8)}
