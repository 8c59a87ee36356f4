"""Normalising, extraction, landing, snapshots and streams on small frames."""

from __future__ import annotations

import json
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from hearthline.operators import extraction, normalise, snapshots, workflow
from hearthline.sources import html, landing
from hearthline.streaming import jobs

NOW = datetime(2026, 8, 28, 12)


def test_normalised_listing(spark):
    card = "id int, title_raw string, price_raw string, currency_raw string, size_raw string, rooms_raw string, floor_raw string, location_raw string"
    cards = spark.createDataFrame([(1, "Stan", "180.000 EUR", None, "72 m2", "2,5", None, "Beograd, Blok 45"), (2, " ", None, None, None, None, "prizemlje", None)], card)
    details = spark.createDataFrame([(1, "", None, None, None, None, None, None, "na 5. spratu", "Pera", "Alfa")], card + ", description_raw string, seller_raw string, agency_raw string")
    got = {r.id: r for r in normalise.normalised_listings(cards, details, "id").collect()}
    one = got[1]
    assert (one.title, one.asking_price, one.currency, one.size_m2, one.price_per_m2) == ("Stan", Decimal("180000.00"), "EUR", Decimal("72.00"), Decimal("2500.00"))
    assert (one.rooms, one.floor, one.city, one.seller_type) == (Decimal("2.50"), 5, "Beograd", "AGENCY")
    assert (got[2].title, got[2].asking_price, got[2].floor, got[2].seller_type) == (None, None, 0, "UNKNOWN")


def test_effective_facts_and_precision(spark):
    props = spark.createDataFrame([("P", None, 3), ("Q", 50.0, None)], "property_id string, size double, rooms int")
    ls = spark.createDataFrame([("P", "REMOVED", NOW, NOW, 70.0, 9), ("P", "ACTIVE", NOW - timedelta(1), NOW, 72.0, 4)], "property_id string, status string, last_seen timestamp, created_at timestamp, size double, rooms int")
    got = {r.property_id: r for r in normalise.effective_facts(props, ls, ["size", "rooms"]).collect()}
    assert (got["P"].size, got["P"].size_source, got["P"].rooms, got["Q"].rooms_source) == (72.0, "listing", 3, "unknown")
    have = spark.createDataFrame([("P", None, "CITY"), ("Q", "Blok 1", "MICROZONE")], "property_id string, micro_location string, location_precision string")
    found = spark.createDataFrame([("P", "Blok 2", "MICROZONE"), ("Q", "x", "CITY")], "property_id string, micro_location string, location_precision string")
    assert {r.property_id: r.micro_location for r in normalise.apply_location(have, found).collect()} == {"P": "Blok 2", "Q": "Blok 1"}


def answer(**given):
    level = {"level": "HIGH", "confidence": 80, "evidence": []}
    told = {"value": None, "confidence": 10}
    return json.dumps({"seller_motivation": level, "negotiability": level, "cash_preference": told, "reason_for_sale": told, "condition": told, "legal_claims": [{"code": "ACTIVE_DISPUTE", "confidence": 75}]} | given)


def test_extraction(spark):
    good, odd = answer(), answer(extra=1)

    def provider(text):
        if text == "boom":
            raise RuntimeError("down")
        return odd if text == "odd" else good

    inputs = spark.createDataFrame([(1, "a"), (2, "boom"), (3, "odd"), (4, "seen"), (5, "a")], "id int, input string").withColumn("input_hash", extraction.input_hash(F.col("input")))
    cache = inputs.filter("id = 4").select("input_hash", F.lit("SUCCESS").alias("status"), F.lit(answer()).alias("answer"))
    hits, misses = extraction.cached(inputs, cache)
    assert [r.id for r in hits.collect()] == [4] and misses.count() == 3
    told = extraction.ask(misses, provider).join(inputs.dropDuplicates(["input_hash"]), "input_hash")
    assert {r.input: r.status for r in told.collect()} == {"a": "SUCCESS", "boom": "FAILED", "odd": "INVALID_OUTPUT"}
    assert [(r.code, r.effect) for r in extraction.claims(told, "input").collect()] == [("ACTIVE_DISPUTE", "BLOCK")]


@pytest.mark.parametrize("bad", ["{", "[]", answer(condition={"value": "x", "confidence": 101}), answer(negotiability={"level": "MUCH", "confidence": 1}), answer(risk_signals=[{"code": "", "confidence": 1}]), answer(legal_claims=[{"code": "X", "confidence": 5}] * 13)])
def test_invalid_answers(bad):
    assert extraction.flaw(bad)
    assert extraction.flaw(answer()) is None


def test_html(spark):
    page = '<title>A</title><a href="/s?strana=3">x</a><a href="/s?strana=2">y</a><script type="application/ld+json">{"@graph":[{"@type":"ItemList","itemListElement":[{"position":1,"url":"https://a.b/1?q","name":"N &quot;x&quot;"},{"position":2,"url":"https://a.b/1"}]}]}</script><p data-id="7" data-x="1 &amp; 2">Hi  <b>you</b></p>'
    frame = spark.createDataFrame([(1, "/s?strana=1", page), (2, "/t", "<p>none</p>")], "id int, url string, html string")
    assert [(r.id, r.position, r.url, r.name) for r in html.search_cards(frame, "id").collect()] == [(1, 1, "https://a.b/1", 'N "x"')]
    got = frame.select(html.next_page(F.col("url"), F.col("html")).alias("n"), html.attributes(F.regexp_extract("html", "<p[^>]*>", 0)).alias("a"), html.plain_text(F.lit("<p>Hi  <b>you</b></p>")).alias("t")).collect()
    assert (got[0].n, got[1].n, got[0].a, got[0].t) == (2, None, {"data-id": "7", "data-x": "1 & 2"}, "Hi you")


def test_landing(spark):
    records = spark.createDataFrame([(1, "CARD", "x"), (1, "CARD", "x"), (1, "DETAIL", "x"), (2, "CARD", "y")], "listing_id long, record_type string, payload string")
    first = landing.landed(records, spark.createDataFrame([], "listing_id long, record_type string, content_hash string"))
    assert first.count() == 3 and landing.landed(records, first).count() == 0
    cards = spark.createDataFrame([("e1", "m1", 2, 1, "b"), ("e1", "m1", 1, 9, "a"), ("e2", "m2", 1, 1, "c")], "external_id string, market string, page int, position int, v string")
    assert {r.external_id: r.v for r in landing.first_cards(cards).collect()} == {"e1": "a", "e2": "c"}
    have = spark.createDataFrame([("a", "A", True)], "code string, name string, is_enabled boolean")
    assert sorted(r.code for r in landing.ensure_sources(have, [landing.SourceConfig("a", "x"), landing.SourceConfig("b", "B")]).collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        landing.SourceConfig("a", "x", size_min=9, size_max=1)


def test_delivery_retries_up_to_three_times(spark):
    alerts = spark.createDataFrame([(1, "PENDING", 0, NOW), (2, "FAILED", 2, NOW), (3, "FAILED", 3, NOW), (4, "SENT", 1, NOW)], "alert_id long, status string, attempts int, created_at timestamp")
    got = {r.alert_id: (r.status, r.attempts) for r in landing.deliver_due(alerts, lambda a: a["alert_id"] == 1 or 1 / 0).collect()}
    assert got == {1: ("SENT", 1), 2: ("FAILED", 3)}


def test_snapshot_and_outcomes(spark):
    props = spark.createDataFrame([("P",), ("Q",)], "property_id string")
    deal = spark.createDataFrame([("P", NOW - timedelta(2), NOW, 1, 9000.0, 100.0), ("P", NOW + timedelta(2), NOW, 2, 1.0, 1.0)], "property_id string, as_of timestamp, created_at timestamp, id int, profit double, max_buy double")
    snap = snapshots.property_snapshot(props, {"deal": deal, "valuation": deal}, F.lit(NOW))
    assert {r.property_id: r.deal and r.deal.id for r in snap.collect()} == {"P": 1, "Q": None}
    deals = snapshots.shadow_deals(snap, 5000)
    known = spark.createDataFrame([("P", NOW + timedelta(7), NOW + timedelta(8), 1, "BOUGHT_BY_USER", 97.0)], "property_id string, outcome_date timestamp, created_at timestamp, id int, outcome_type string, sale_price double")
    at = lambda d: snapshots.outcomes(deals, known, F.lit(NOW + timedelta(d))).first()
    assert (at(7).status, at(10).status, at(10).days_open) == ("OPEN", "MEASURED", 7)
    told = spark.range(1).select(workflow.classified(snapshots.is_positive(F.lit("BOUGHT_BY_USER"), F.lit(97.0), F.lit(100.0)), F.lit(True)).alias("c"))
    assert told.first().c == "TRUE_POSITIVE"


def test_command_validation(spark):
    frame = spark.createDataFrame([(1, 1, 2, 3), (2, 3, 2, 4), (3, -1, None, None), (4, None, None, None)], "id int, lo int, mid int, hi int")
    good, bad = workflow.accepted(frame, workflow.valid_estimate(F.col("lo"), F.col("mid"), F.col("hi")))
    assert [r.id for r in good.collect()] == [1, 4] and [r.id for r in bad.collect()] == [2, 3]


def test_stream_over_two_runs_keeps_state(spark, tmp_path):
    schema = "user_id long, event_id long, ts timestamp, price long"

    def land(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        return sorted((r.event_id, r.old_value, r.new_value) for r in jobs.run_available(jobs.price_changes(stream, "user_id", "ts", "event_id", "price"), f"{tmp_path}/out").collect())

    land([(1, 1, NOW, 100), (1, 2, NOW + timedelta(1), 90)], "a")
    assert run() == [(2, 100, 90)]
    land([(1, 3, NOW + timedelta(2), 90), (1, 4, NOW + timedelta(3), 95), (1, 5, NOW - timedelta(9), 1)], "b")
    assert run() == [(2, 100, 90), (4, 90, 95)]
