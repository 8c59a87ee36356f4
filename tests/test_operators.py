"""Operators on small frames with known results."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.operators import changes, deals, features, matching, opportunity, rows, valuation, workflow

AS_OF = datetime(2026, 8, 28, 12)


def test_price_cuts_golden(spark):
    cut = lambda days, old, new, k: (1, AS_OF - timedelta(days=days), k, Decimal(old), Decimal(new))
    ev = spark.createDataFrame([cut(40, 200000, 190000, 1), cut(30, 190000, 180000, 2)], "p long, at timestamp, event_id long, old_price decimal(14,2), new_price decimal(14,2)")
    got = features.price_cuts(ev, "p", F.lit(AS_OF)).first()
    assert (got.cut_count, got.total_pct, got.pct_30d, got.largest_pct, got.pct_7d) == (2, Decimal("10.0000"), Decimal("5.2632"), Decimal("5.2632"), 0)


def test_listing_aggregates_golden(spark):
    ls = [("P", "ACTIVE", 182000, AS_OF - timedelta(days=70), "OWNER"), ("P", "ACTIVE", 180000, AS_OF - timedelta(days=20), "AGENCY")]
    got = features.listing_aggregates(spark.createDataFrame(ls, "property_id string, status string, price long, first_seen timestamp, seller string"), F.lit(AS_OF)).first()
    assert (got.listing_age_days, got.market_age_days, got.active_count, got.relist_count, got.lowest_price, got.highest_price, got.owner_present, got.agency_count) == (20, 70, 2, 1, 180000, 182000, True, 1)


def deal(**given):
    row = {"price": 130000, "exit": 165000, "renovation": 5000, "days": 365, "reserve": 0, "rules": {"notary": {"fixed": 5000}, "holding": {"fixed": 1000}}} | given
    c = lambda k: F.lit(row[k]).cast(deals.MONEY)
    return deals.economics(c("price"), c("exit"), c("renovation"), F.lit(row["days"]), c("reserve"), row["rules"])


def test_economics_golden(spark):
    one = lambda e: spark.range(1).select(*(v.alias(k) for k, v in e.items())).first()
    got = one(deal())
    assert (got.basis, got.profit, got.roi) == (Decimal("141000.00"), Decimal("24000.00"), Decimal("0.170213"))
    got = one(deal(price=100000, exit=120000, renovation=0, rules={"taxes": {"price_pct": "2.5"}, "sale": {"exit_pct": 3}}))
    assert (got.profit, got.roi) == (Decimal("13900.00"), Decimal("0.135610"))
    assert one(deal(days=0)).annual_roi is None


def test_max_buy_is_the_last_cent_that_fits(spark):
    frame = spark.createDataFrame([(0, 5), (1, 1), (100, 0), (16500000, 13300000), (999, 999)], "exit long, most long")
    got = frame.select("exit", "most", deals.max_buy_cents(F.col("exit"), lambda c: c <= F.col("most")).alias("got")).collect()
    assert [r.got for r in got] == [min(r.exit, r.most) for r in got]


def test_scenarios(spark):
    base = spark.createDataFrame([("D", 100.0, 101, 1, 2, 3)], "id string, renovation double, days int, exit_low int, exit_base int, exit_high int")
    got = {r.scenario: (r.scenario_renovation, r.scenario_days, r.exit_value) for r in deals.scenario_rows(base).collect()}
    assert got == {"DOWNSIDE": (Decimal("120.00"), 126, 1), "BASE": (Decimal("100.00"), 101, 2), "UPSIDE": (Decimal("90.00"), 76, 3)}


def test_weighted_median_takes_the_lower(spark):
    frame = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("b", 3, 1), ("b", 9, 4)], "k string, v int, w int")
    assert {r.k: r.median for r in rows.weighted_median(frame, ["k"], "v", "w").collect()} == {"a": 1, "b": 9}


def test_asof_sees_no_future(spark):
    frame = spark.createDataFrame([(1, 10, 1, "x"), (1, 20, 2, "y"), (1, 30, 3, "z")], "k int, at int, id int, v string")
    assert rows.asof_latest(frame, ["k"], "at", F.lit(20), ["id"]).first().v == "y"
    assert rows.asof_first_after(frame, ["k"], "at", F.lit(20), ["id"]).first().v == "z"
    past = frame.filter("at <= 20")
    assert rows.asof_latest(past, ["k"], "at", F.lit(20), ["id"]).collect() == rows.asof_latest(frame, ["k"], "at", F.lit(20), ["id"]).collect()


def test_outliers_golden(spark):
    frame = spark.createDataFrame([("T", k, float(v), None) for k, v in enumerate([3000, 3050, 3100, 3080, 9000])], "t string, id int, v double, exclusion string")
    got = {r.id: r.exclusion for r in valuation.without_outliers(frame, "t", "v").collect()}
    assert got == {0: None, 1: None, 2: None, 3: None, 4: "PRICE_OUTLIER"}
    few = {r.exclusion for r in valuation.without_outliers(frame.filter("id < 2"), "t", "v").collect()}
    assert few == {"INSUFFICIENT_COMP_COUNT"}


def test_adaptive_radius_widens(spark):
    near = [("T", k, d, 0.9, 30) for k, d in enumerate([100.0, 290.0, 400.0, 900.0, 1300.0])]
    frame = spark.createDataFrame(near, "t string, id int, distance_m double, similarity double, age_days int")
    got = valuation.adaptive_radius(frame, "t").collect()
    assert {r.radius_m for r in got} == {1200} and len(got) == 4


def test_snapshot_events(spark):
    schema = "k int, price int, description string, seller string, status string"
    old = spark.createDataFrame([(1, 100, "a", "s", "ACTIVE"), (2, 100, "a", "s", "NOT_SEEN")], schema)
    new = spark.createDataFrame([(1, 90, "b", "s", "ACTIVE"), (2, None, None, "t", "ACTIVE"), (3, 5, "c", None, "ACTIVE")], schema)
    got = sorted((r.k, r.event_type) for r in changes.snapshot_events(old, new, "k").collect())
    assert got == [(1, "DESCRIPTION_CHANGED"), (1, "PRICE_CHANGED"), (2, "REAPPEARED"), (2, "SELLER_CHANGED"), (3, "DISCOVERED")]


def test_missing_needs_a_complete_scan(spark):
    ls = spark.createDataFrame([(1, "ACTIVE", 0), (2, "NOT_SEEN", 1)], "k int, status string, misses int")
    got = {r.k: (r.first_miss, r.misses, r.status) for r in changes.missing(ls, ls.limit(0), "k").collect()}
    assert got == {1: (True, 1, "NOT_SEEN"), 2: (False, 2, "NOT_SEEN")}
    assert changes.missing(ls, ls.limit(0), "k", complete=False).count() == 0


def test_resolve(spark):
    ls = spark.createDataFrame([(1, ["bulevar", "10"], ["bulevar"], 72.0, 3.0, 2), (2, ["bulevar", "10"], ["bulevar"], 95.0, 4.0, 8), (3, ["x"], ["x"], None, None, None)], "listing_id int, tokens array<string>, words array<string>, size double, rooms double, floor int")
    ps = spark.createDataFrame([("P", ["bulevar", "10"], 72.0, 3.0, 2)], "property_id string, p_tokens array<string>, p_size double, p_rooms double, p_floor int")
    got = {r.listing_id: (r.action, r.property_id) for r in matching.resolve(ls, ps).collect()}
    assert got == {1: ("AUTO_MATCH", "P"), 2: ("NEW_PROPERTY", None), 3: ("NEW_PROPERTY", None)}


def test_candidates_let_unknown_sizes_and_rooms_pass(spark):
    """As the reference filters: unknown passes, and a listing without size and rooms has no candidates."""
    ls = [(k, ["bulevar", "10"] if k % 2 else ["x"], ["bulevar"], size, rooms, None) for k, (size, rooms) in enumerate([(s, r) for s in (72.0, None) for r in (3.0, None) for _ in range(2)])]
    ps = [(f"P{k}", ["bulevar", "10", "a"], size, rooms, None) for k, (size, rooms) in enumerate([(s, r) for s in (72.0, 150.0, None) for r in (3.0, 9.0, None)])]
    lf = spark.createDataFrame(ls, "listing_id int, tokens array<string>, words array<string>, size double, rooms double, floor int")
    pf = spark.createDataFrame(ps, "property_id string, p_tokens array<string>, p_size double, p_rooms double, p_floor int")
    fits = lambda a, b, w: a is None or b is None or abs(a - b) <= w
    want = sorted((l[0], p[0]) for l in ls for p in ps if (l[3], l[4]) != (None, None) and fits(l[3], p[2], 25) and fits(l[4], p[3], 2) and (l[0] % 2 or l[3] == p[2] == 72))  # noqa: E741
    assert sorted((r.listing_id, r.property_id) for r in matching.candidates(lf, pf).collect()) == want


def test_max_buy_without_a_search(spark):
    """The closed form finds what the binary search finds, also over rounded percentages."""
    rows_ = [(e, n, f, p, r) for e in (0, 1, 99_999, 12_345_678) for n in (-5, 100, 98_765, 12_000_001) for f in (0, 777) for p in (0, 1_000, 50_000) for r in (0, 100_000, 1_500_000)]
    frame = spark.createDataFrame(rows_, "exit long, net long, fixed long, least long, roi long")
    c = F.col
    pcts = [F.lit(25_000), F.lit(12_345), F.lit(333)]
    basis = lambda x: sum((F.call_function("div", 2 * x * p + 1_000_000, F.lit(2_000_000).cast("long")) for p in pcts), x + c("fixed"))
    fits = lambda x: (c("net") - basis(x) >= c("least")) & ((c("net") - basis(x)) * 1_000_000 >= c("roi") * basis(x))
    got = frame.select(deals.max_buy_linear(c("exit"), c("net"), c("fixed"), pcts, c("least"), c("roi")).alias("a"), deals.max_buy_cents(c("exit"), fits).alias("b")).collect()
    assert all(r.a == r.b for r in got) and len({r.a for r in got}) > 10


def test_pipeline_never_falls(spark):
    steps = spark.createDataFrame([("a", 1, "CALLED"), ("a", 2, "REVIEWED"), ("b", 1, "LOST"), ("b", 2, "WON"), ("b", 3, "VISITED"), ("c", 1, "??")], "p string, t int, status string")
    got = {r.p: r.status for r in workflow.pipeline_state(steps, "p", ["t"]).collect()}
    assert got == {"a": "CALLED", "b": "LOST"}


def test_cooldown_counts_from_the_last_alert(spark):
    at = lambda h: AS_OF + timedelta(hours=h)
    ev = spark.createDataFrame([(k, "x", at(h)) for k, h in enumerate([0, 3, 5.9, 6, 11, 12.5])], "id long, key string, ts timestamp")
    assert sorted(r.id for r in opportunity.cooled(ev, ["key"], "ts", "id").collect()) == [0, 3, 5]


def test_cooldown_passes_over_many_keys_in_few_calls(spark):
    """Keys of a task are one stream of batches, whatever their number: no group of their own for each session."""
    events = spark.range(60_000).selectExpr("id", "id % 20000 AS key", "timestamp_seconds((id div 20000) * 5 * 3600) AS ts").union(spark.sql("SELECT 60001L, NULL, timestamp_seconds(0) UNION ALL SELECT 60002L, NULL, timestamp_seconds(3600) UNION ALL SELECT 60003L, 7L, NULL"))
    frame = opportunity.cooled(events, ["key"], "ts", "id")
    assert "FlatMapGroups" not in frame._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in frame.collect()) == [*range(20_000), *range(40_000, 60_000), 60_001, 60_003]


def test_radius_pairs_of_repeated_places(spark):
    """A distance is told once for rows of one place, also where these are cut into parts."""
    left = spark.range(2500).selectExpr("id AS a", "44.8 + id % 2 / 1000 AS lat", "20.4D AS lon").selectExpr("a", "CAST(lat AS double) AS lat", "lon")
    right = spark.range(1500).selectExpr("id AS b", "CAST(IF(id % 3 = 0, NULL, 44.8 + id % 3 / 50) AS double) AS lat2", "20.4D AS lon2")
    got = rows.radius_pairs(left, right, 2300.0)
    assert {k: v for k, v in ((r["k"], r["n"]) for r in got.groupBy(F.expr("concat(a % 2, b % 3)").alias("k")).agg(F.count("*").alias("n")).collect())} == {"01": 625_000, "11": 625_000}
    assert got.select("a", "b").distinct().count() == 1_250_000 and got.columns == ["a", "lat", "lon", "b", "lat2", "lon2", "distance_m"]


def test_action_cascade(spark):
    def act(gate="PASS", missing=(), low=(), economic=(), neg=0.05, total=70, signals=0, strong=False):
        codes = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
        return spark.range(1).select(opportunity.action(F.lit(gate), codes(missing), codes(low), codes(economic), F.lit(neg), F.lit(total), F.lit(signals), F.lit(strong)).alias("a")).first().a

    assert act() == "CALL"
    assert act(gate="BLOCK") == "IGNORE"
    assert act(missing=["X"]) == "REVIEW"
    assert act(economic=["NEGATIVE_EXPECTED_PROFIT"]) == "IGNORE"
    assert act(economic=["ROI_BELOW_MIN"]) == "REVIEW"
    assert act(economic=["REQUIRED"], neg=0.2) == "WATCH"
    assert act(neg=0.02, total=85, signals=1) == "URGENT_CALL"
    assert act(neg=0.5, total=85) == "IGNORE"


def test_state_at(spark):
    ev = spark.createDataFrame([(1, 5, 1, "a", "b"), (1, 15, 2, "b", "c"), (2, 5, 3, "x", "y")], "k int, at int, event_id int, old_value string, new_value string")
    cur = spark.createDataFrame([(1, "c"), (2, "y"), (3, "z")], "k int, value string")
    assert {r.k: r.value for r in workflow.state_at(ev, cur, "k", F.lit(10)).collect()} == {1: "b", 2: "y", 3: "z"}


def test_first_come_is_the_sequential_pass(spark):
    rnd = random.Random(3)
    edges = {(v, u): rnd.random() for v in range(30) for u in range(v) if rnd.random() < 0.12}
    owner = {}
    for v in range(30):
        near = [(s, -u) for (w, u), s in edges.items() if w == v and owner[u] == u]
        owner[v] = -max(near)[1] if near else v
    nodes = spark.createDataFrame([(v,) for v in range(30)], "node long")
    frame = spark.createDataFrame([(v, u, s) for (v, u), s in edges.items()], "node long, earlier long, similarity double")
    assert {r.node: r.owner for r in matching.first_come(nodes, frame).collect()} == owner


def test_resolve_new(spark):
    same = (["bulevar", "10"], ["bulevar"], 72.0, 3.0, 2)
    ls = spark.createDataFrame([(1, *same), (2, *same), (3, ["bulevar", "10"], ["x"], 95.0, 4.0, 8)], "listing_id long, tokens array<string>, words array<string>, size double, rooms double, floor int")
    assert {r.node: r.owner for r in matching.resolve_new(ls).collect()} == {1: 1, 2: 1, 3: 3}


def test_running_totals_over_chunks(spark):
    """A hot key, a null key and small ones; chunks of three rows give what one sorted pass gives."""
    rnd = random.Random(8)
    data = [(key, at, rnd.choice([None, *range(9)])) for key, n in (("hot", 400), (None, 90), ("a", 3), ("b", 1)) for at in rnd.sample(range(1000), n)]
    frame = spark.createDataFrame(data, "k string, at long, w long")
    for most in (3, 65_536):
        got = {(r.k, r.at): r.run for r in rows.running_totals(frame, ["k"], ["at"], {"run": "w"}, most).collect()}
        want, run = {}, {}
        for k, at, w in sorted(data, key=lambda r: r[1]):
            run[k] = want[(k, at)] = run.get(k, 0) + (w or 0)
        assert got == want


def test_order_statistics_of_a_hot_key(spark, monkeypatch):
    """Medians, quartiles and band totals of a key of many values, cut into small chunks, against plain versions."""
    plain = rows.running_totals
    monkeypatch.setattr(rows, "running_totals", lambda *a, **k: plain(*a, rows_a_chunk=5, **k))
    rnd = random.Random(9)
    data = [("hot", rnd.randrange(500), rnd.randint(1, 5)) for _ in range(700)] + [(None, 4, 1), (None, 9, 3), ("a", 7, 2), ("none", None, 1)]
    frame = spark.createDataFrame(data, "k string, v long, w long")
    mid = {r.k: r.median for r in rows.weighted_median(frame.filter("v is not null"), ["k"], "v", "w").collect()}
    q = {r.k: (r.q25, r.q50, r.q75) for r in rows.quartiles(frame, ["k"], "v").collect()}
    assert q.pop("none") == (None, None, None)
    for key in ("hot", None, "a"):
        values = sorted(v for k, v, _ in data if k == key)
        each = sorted(v for k, v, w in data if k == key for _ in range(w))
        assert mid[key] == each[(len(each) + 1) // 2 - 1]
        assert q[key] == pytest.approx(tuple(float(x) for x in np.percentile(values, [25, 50, 75])))
    left, right = [("hot", rnd.randrange(500), k % 7) for k in range(300)], [("hot", rnd.randrange(500), k) for k in range(400)]
    a, b = spark.createDataFrame(left, "k string, x long, o long"), spark.createDataFrame(right, "k string, y long, z long")
    got = {(r.k, r.x, r.o): (r.n, r.s) for r in rows.band_totals(a, b, ["k"], "x", "y", 20, {"n": F.count("*"), "s": F.sum("z")}, ["o"]).collect()}
    assert got == {(k, x, o): (sum(abs(x - y) <= 20 for _, y, _ in right), sum(z for _, y, z in right if abs(x - y) <= 20)) for k, x, o in left}
