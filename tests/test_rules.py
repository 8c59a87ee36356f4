"""Scalar rules on known values."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from hearthline.functions import numbers, text
from hearthline.operators import liquidity, matching, sellers, valuation, workflow
from hearthline.plans import rules


def value(spark, column, **row):
    types = {str: "string", int: "int", float: "double", bool: "boolean", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in row.items()) or "x int"
    return spark.createDataFrame([tuple(row.values()) or (1,)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "scale", "want"), [
    ("180.000 EUR", 2, "180000.00"), ("60 m2", 2, "60.00"), ("2,5", 2, "2.50"), ("Cena na upit", 2, None),
    ("1.234.567,89", 2, "1234567.89"), ("12.5", 2, "12.50"), ("2.125", 2, "2125.00"), ("", 2, None), (None, 2, None),
])
def test_parse_decimal(spark, raw, scale, want):
    got = value(spark, text.parse_decimal(F.col("r"), scale), r=raw)
    assert got == (Decimal(want) if want else None)


@pytest.mark.parametrize(("raw", "floor", "floors"), [("na 5. spratu", 5, None), ("prizemlje", 0, None), ("2/5", 2, 5), ("bez", None, None)])
def test_floors(spark, raw, floor, floors):
    assert value(spark, text.parse_floor(F.col("r")), r=raw) == floor
    assert value(spark, text.parse_total_floors(F.col("r")), r=raw) == floors


def test_text_rules(spark):
    assert value(spark, text.parse_currency(F.col("r")), r="100 €") == "EUR"
    assert value(spark, text.parse_seller_type(F.col("r"), F.lit("X doo")), r="vlasnik") == "AGENCY"
    assert value(spark, text.ascii_fold(F.col("r")), r="Đorđe Žižić") == "ore zizic"
    assert value(spark, text.token_set(F.col("r")), r="a The the 45 blok") == ["45", "blok", "the"]
    assert value(spark, text.canonical_url(F.col("r")), r="https://a.b/c/?q=1#z") == "https://a.b/c"
    assert value(spark, text.micro_location(F.col("r")), r="Novi Beograd - BLOK 45") == "Blok 45"
    assert value(spark, text.first_text(F.col("r"), F.lit(" x ")), r="  ") == "x"


def test_ratios(spark):
    assert value(spark, numbers.price_per_m2(F.lit("180000").cast("decimal(14,2)"), F.lit("72").cast("decimal(10,2)"))) == Decimal("2500.00")
    assert value(spark, numbers.drop_pct(F.lit("190000").cast("decimal(14,2)"), F.lit("180000").cast("decimal(14,2)"))) == Decimal("5.2632")
    assert value(spark, numbers.known_weighted_mean([(F.lit(1.0), 3), (F.lit(None).cast("double"), 7)])) == 1.0
    assert value(spark, numbers.known_weighted_mean([(F.lit(None).cast("double"), 7)])) is None
    later, earlier = F.lit("2026-01-03 11:59:59").cast("timestamp"), F.lit("2026-01-01 12:00:00").cast("timestamp")
    assert value(spark, numbers.elapsed_days(later, earlier)) == 1
    assert value(spark, numbers.elapsed_days(earlier, later)) == 0
    metres = value(spark, numbers.haversine_m(F.lit(44.8051), F.lit(20.4002), F.lit(44.8132), F.lit(20.4002)))
    assert metres == pytest.approx(900.7, abs=0.5)


def test_matching_rules(spark):
    one = lambda c: value(spark, c)
    assert one(matching.size_score(F.lit(72), F.lit(73))) == 0.95
    assert one(matching.floor_score(F.lit(2), F.lit(4))) == 0.0
    auto = matching.auto_match(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(True), F.lit(0.9))
    assert one(matching.decision(auto, F.lit(0.9), F.lit(False))) == "AUTO_MATCH"
    unknown = matching.auto_match(F.lit(1.0), F.lit(0.95), F.lit(1.0), F.lit(None).cast("double"), F.lit(False), F.lit(0.9))
    assert one(matching.decision(unknown, F.lit(0.9), F.lit(False))) == "POSSIBLE_MATCH"
    assert one(matching.decision(F.lit(False), F.lit(0.9), F.lit(True))) == "NEW_PROPERTY"


def test_valuation_rules(spark):
    one = lambda c: value(spark, c)
    assert [one(valuation.distance_score(F.lit(m))) for m in (100, 101, 800, 1200, 1201)] == [1.0, 0.9, 0.6, 0.45, 0.0]
    assert one(valuation.condition_level(F.lit("za renoviranje"))) == 4  # the first word of the ladder decides
    assert one(valuation.condition_level(F.lit("needs_renovation"))) == 1
    assert one(valuation.condition_level(F.lit("?"))) is None
    assert [one(valuation.confidence_category(F.lit(x))) for x in (39.0, 39.5, 75.0, 90.0)] == ["LOW", "LIMITED", "HIGH", "VERY_HIGH"]


def test_liquidity_unknown_is_not_negative(spark):
    known = {"parking": liquidity.parking_points(F.lit(False)), "rooms": liquidity.rooms_points(F.lit(2.0))}
    unknown = {"parking": liquidity.parking_points(F.lit(None).cast("boolean")), "rooms": liquidity.rooms_points(F.lit(2.0))}
    assert value(spark, liquidity.assess(known)[0]) == 54
    assert value(spark, liquidity.assess(unknown)[0]) == 56
    assert value(spark, liquidity.assess(unknown)[2]) == ["parking"]


@pytest.mark.parametrize(("raw", "gate", "score"), [("", "VERIFY", None), ("suvlasnistvo, 1/2 udeo", "BLOCK", 95), ("neuknjizen", "VERIFY", 70), ("lep stan", "PASS", 0)])
def test_legal_gate(spark, raw, gate, score):
    status, points, _ = sellers.gate(sellers.legal_flags(F.col("r")))
    assert value(spark, status, r=raw) == gate
    assert value(spark, points, r=raw) == score


@pytest.mark.parametrize(("kind", "threshold", "old", "new", "hit"), [
    ("PRICE_BELOW", 100.0, 110.0, 100.0, True), ("PRICE_BELOW", 100.0, 99.0, 98.0, False), ("PRICE_DROP_PERCENT", 1.0, 100.0, 99.0, True),
    ("PRICE_DROP_PERCENT", 0.99, 100.0, 50.0, False), ("ANY_PRICE_CHANGE", 0.0, 5.0, 5.0, False),
])
def test_watch_rules(spark, kind, threshold, old, new, hit):
    fires = workflow.rule_fires(F.col("k"), F.col("t"), F.col("o"), F.col("n"))
    assert value(spark, fires, k=kind, t=threshold, o=old, n=new) is hit


def test_similar_parts_of_equal_facts(spark):
    """Forty equal parts are one profile: each takes the least ids of others, and no pair of two of them is made."""
    equal = [(k, "B", "T", 20, 9.0) for k in range(40)]
    others = [(50, "B", "T", 20, 20.0), (51, "B", "U", 20, 9.0), (52, "B", None, 24, 9.0), (53, "C", "T", 20, 9.0), (54, None, "T", 20, 9.0), (55, "C", "T", 21, None)]
    part = spark.createDataFrame(equal + others, "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double")
    got = {}
    for r in rules.similar_parts(part).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other, r.score))
    assert {k: sorted(v) for k, v in got.items() if k in (0, 5, 39)} == {
        k: [(n, x, 4500) for n, x in enumerate([x for x in range(13) if x != k][:12], 1)] for k in (0, 5, 39)
    }
    assert sorted(got[52]) == [(n, x, 600 + 400 + 1500) for n, x in enumerate(range(12), 1)]
    assert sorted(got[53]) == [(1, 55, 2000 + 1000 + 300)] and sorted(got[55]) == [(1, 53, 3300)] and 54 not in got
