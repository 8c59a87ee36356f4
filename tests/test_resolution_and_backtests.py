"""Blocking, components, first come, and back-tests against plain versions."""

from __future__ import annotations

import datetime
import random
import time

import pytest

from hearthline.operators import evaluation, matching
from hearthline.operators.graphs import components
from hearthline.operators.rows import salted_join

rnd = random.Random(2)
LISTING = "listing_id long, tokens array<string>, words array<string>, size double, rooms double, floor int"
PROPERTY = "property_id long, p_tokens array<string>, p_size double, p_rooms double, p_floor int"


def test_salted_join_is_the_join(spark):
    a = spark.createDataFrame([(k % 7, k) for k in range(60)], "k long, x long")
    b = spark.createDataFrame([(0, k) for k in range(50)] + [(k, 100 + k) for k in range(9)] + [(None, 1)], "k long, y long")
    got = sorted(tuple(r) for r in salted_join(a, b, ["k"], ["y"], most=4).select("k", "x", "y").collect())
    assert got == sorted(tuple(r) for r in a.join(b, "k").select("k", "x", "y").collect())


def _pairs(listings, properties):
    """Every pair that the windows let pass and scoring keeps, by names."""
    found = set()
    for i, tokens, _, size, rooms, _ in listings:
        for j, p_tokens, p_size, p_rooms, _ in properties:
            if size is None and rooms is None:
                continue
            if None not in (size, p_size) and abs(size - p_size) > 25 or None not in (rooms, p_rooms) and abs(rooms - p_rooms) > 2:
                continue
            if set(tokens or ()) & set(p_tokens or ()) or None not in (size, p_size) and abs(size - p_size) <= 1:
                found.add((i, j))
    return found


def test_blocking_loses_no_pair(spark, monkeypatch):
    names = ["beograd", "zemun", "blok", "45", "ulica", "kej"]
    one = lambda: rnd.sample(names, rnd.randint(0, 3))
    number = lambda top, step: rnd.choice([None, *[x * step for x in range(top)]])
    listings = [(k, one(), one(), number(30, 3.5), number(9, 0.5), number(4, 1)) for k in range(120)] + [(200, None, None, 50.0, 2.0, 1), (201, ["blok"], ["blok"], None, None, 1)]
    properties = [(k, one(), number(30, 3.4), number(9, 0.5), number(4, 1)) for k in range(110)] + [(300, None, 50.5, None, None)]
    ls = spark.createDataFrame(listings, LISTING).withColumnRenamed("listing_id", "l")
    ps = spark.createDataFrame(properties, PROPERTY).withColumnRenamed("property_id", "p")
    got = [(r.l, r.p) for r in matching.blocked_pairs(ls, ps).select("l", "p").collect()]
    assert len(got) == len(set(got)) and set(got) == _pairs(listings, properties)


def test_pairs_above_lose_none_and_are_few(spark):
    """Of all blocked pairs, those that reach what five others reach, and of the others few, whatever is unknown."""
    some = lambda *xs: rnd.choice([None, *xs])
    tokens = lambda: rnd.choice([["novi"], ["novi", f"blok{rnd.randrange(3)}", f"ulica{rnd.randrange(6)}"], [f"blok{rnd.randrange(3)}", f"ulica{rnd.randrange(6)}"], [f"ulica{rnd.randrange(6)}", *(f"x{k}" for k in range(9))]])
    facts = lambda: (some(*(30 + k / 2 for k in range(120))), some(1.0, 1.5, 2.0, 3.0, 4.0), some(0, 1, 2, 5))
    listings = [(k, t := tokens(), [*t, *rnd.choice([[], ["red"], ["blok1", "red"]])], *facts()) for k in range(150)]
    ls = spark.createDataFrame(listings, LISTING).withColumnRenamed("listing_id", "l")
    ps = spark.createDataFrame([(k, tokens(), *facts()) for k in range(600)], PROPERTY).withColumnRenamed("property_id", "p")
    left, right = matching.prepared(ls, ps)
    left = matching.with_least(left, right, 5).localCheckpoint()
    least = {r.l: r.least for r in left.select("l", "least").collect()}
    got = [(r.l, r.p, r.similarity) for r in matching.scored(matching.pairs_above(left, right)).select("l", "p", "similarity").collect()]
    every = [(r.l, r.p, r.similarity) for r in matching.scored(matching.blocked_pairs(ls, ps)).select("l", "p", "similarity").collect()]
    want = {x for x in every if x[2] >= least[x[0]]}
    assert len(got) == len(set(got)) and want <= set(got) <= set(every) and 3 * len(got) < 2 * len(every)
    assert sum(x > 0 for x in least.values()) > 50
    for k in least:
        assert least[k] < 0 or sum(x[0] == k and x[2] >= least[k] for x in every) >= 5


def test_profiles_and_rejected_pairs(spark):
    """Forty properties of equal facts are one profile; a listing that turned down the first 25 still sees 15."""
    listing = (["blok 1"], ["blok 1"], 50.0, 2.0, 3)
    ls = spark.createDataFrame([(k, *listing) for k in range(4)], LISTING)
    ps = spark.createDataFrame([(k, ["blok 1"], 50.0, 2.0, 3) for k in range(40)], PROPERTY)
    rejected = spark.createDataFrame([(1, k) for k in range(25)], "listing_id long, property_id long")
    got = {}
    for r in matching.candidates(ls, ps, 20, rejected).collect():
        got.setdefault(r.listing_id, []).append(r.property_id)
    assert sorted(got[0]) == list(range(20)) and sorted(got[1]) == list(range(25, 40))
    actions = {r.listing_id: (r.action, r.property_id) for r in matching.resolve(ls, ps, rejected).collect()}
    assert actions[0] == ("AUTO_MATCH", 0) and actions[1] == ("AUTO_MATCH", 25)


def test_candidates_of_null_ids_null_tokens_and_empty_tables(spark):
    """Rows without an id have no candidates; null and repeated tokens count once or not at all."""
    ls = spark.createDataFrame([(1, ["blok", "blok", None], ["blok"], 50.0, 2.0, 3), (2, None, None, 50.0, None, None), (None, ["blok"], ["blok"], 50.0, 2.0, 3)], LISTING)
    ps = spark.createDataFrame([(7, ["blok"], 50.0, 2.0, 3), (8, [None], 50.5, 2.0, None), (None, ["blok"], 50.0, 2.0, 3)], PROPERTY)
    got = {(r.listing_id, r.property_id): (r.s_location, r.s_text, r.similarity) for r in matching.candidates(ls, ps).collect()}
    assert set(got) == {(1, 7), (1, 8), (2, 7), (2, 8)} and got[(1, 7)] == (1.0, 1.0, 1.0) and got[(1, 8)][:2] == got[(2, 7)][:2] == (None, 0.0)
    assert matching.candidates(ls, ps.limit(0)).isEmpty() and matching.candidates(ls.limit(0), ps).isEmpty()


def test_components_over_many_tasks(spark):
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1300)] + [(5000, k) for k in range(5001, 5200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(edges, "u long, v long")
    want = {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    for rows in (90, 500_000):
        got = components(frame, rows).collect()
        assert {r.u: r.root for r in got} == want and len(got) == len(want)


def test_first_come_of_a_chain_of_ten_thousand(spark):
    n = 10_000
    nodes = spark.range(n).withColumnRenamed("id", "node")
    edges = spark.range(1, n).selectExpr("id AS node", "id - 1 AS earlier", "0.9 AS similarity")
    began = time.perf_counter()
    got = {r.node: r.owner for r in matching.first_come(nodes, edges).collect()}
    assert got == {k: k - k % 2 for k in range(n)} and time.perf_counter() - began < 60


def test_first_come_in_rounds_and_in_tasks_agree(spark):
    pairs = [(a, b, round(rnd.random(), 2)) for a in range(60) for b in range(a) if rnd.random() < 0.05]
    edges = spark.createDataFrame(pairs, "node long, earlier long, similarity double")
    nodes = spark.range(60).withColumnRenamed("id", "node")
    whole, rounds = ({r.node: r.owner for r in matching.first_come(nodes, edges, most).collect()} for most in (10**6, 5))
    assert whole == rounds


day = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k)


def test_latest_at_cutoffs_never_looks_ahead(spark):
    rows = [(rnd.randrange(5), day(rnd.randrange(60)), k) for k in range(200)] + [(9, None, 999)]
    points = [day(k) for k in (0, 10, 10, 33, 90)]
    df = spark.createDataFrame(rows, "key long, at timestamp, id long")
    got = {(r.key, r.cutoff): (r.last["at"], r.last["id"]) for r in evaluation.latest_at_cutoffs(df, ["key"], df["at"], ["at", "id"], points, "last").collect()}
    want = {}
    for key, at, k in rows:
        for p in points:
            if at is not None and at <= p:
                want[key, p] = max(want.get((key, p), (at, k)), (at, k))
    assert got == want
    late = df.filter("id < 0")
    assert evaluation.latest_at_cutoffs(late, ["key"], late["at"], ["at", "id"], points, "last").count() == 0


def test_asof_join_of_own_times(spark):
    history = [(rnd.randrange(4), day(rnd.randrange(90)), k) for k in range(150)] + [(0, day(5), 1000), (0, day(5), 1001)]
    asks = [(rnd.randrange(5), day(rnd.randrange(-3, 99)), k) for k in range(80)] + [(0, day(5), 500), (1, None, 501), (0, day(5), 500)]
    got = evaluation.asof_join(spark.createDataFrame(asks, "key long, t timestamp, ask long"), spark.createDataFrame(history, "key long, at timestamp, id long"), ["key"], "t", "at", ["id"], "last", chunk_s=7 * 86_400).collect()
    assert len(got) == len(asks)
    for r in got:
        fit = [(at, k) for key, at, k in history if r.t is not None and key == r.key and at <= r.t]
        assert (None if r.last is None else (r.last["at"], r.last["id"])) == max(fit, default=None)


def test_evaluation_uses_the_opportunity_s_own_deal(spark):
    t = "timestamp"
    opportunities = spark.createDataFrame([(1, day(1), day(1), 1, "CALL", 11), (2, day(1), day(1), 2, "SKIP", None), (3, day(1), day(1), 3, "CALL", 13)], f"property_id long, as_of {t}, created_at {t}, id long, action string, deal_id long")
    deals = spark.createDataFrame([(1, day(0), day(0), 11, 90, -5, 70), (1, day(2), day(2), 12, 50, 5, 60), (3, day(30), day(30), 13, 1, 1, 1)], f"property_id long, as_of {t}, created_at {t}, id long, max_buy long, downside_profit long, cost_basis long")
    values = spark.createDataFrame([(1, day(1), day(1), 1, 100)], f"property_id long, as_of {t}, created_at {t}, id long, fair_value long")
    outcomes = spark.createDataFrame([(1, day(20), day(20), 1, "CONFIRMED_SOLD", 80), (2, day(15), day(40), 2, "BOUGHT_BY_USER", None), (4, day(5), day(5), 4, "SALE_CANCELLED", None)], f"property_id long, outcome_date {t}, created_at {t}, id long, outcome_type string, sale_price long")
    got = {(r.property_id, r.cutoff): r for r in evaluation.evaluation_items([(day(10), day(25)), (day(12), day(50))], opportunities, deals, values, outcomes).collect()}
    assert {k: (r.classification, r.deal_id) for k, r in got.items()} == {
        (1, day(10)): ("TRUE_POSITIVE", 11), (2, day(10)): ("UNKNOWN", None), (3, day(10)): ("UNKNOWN", None), (4, day(10)): ("TRUE_NEGATIVE", None),
        (1, day(12)): ("TRUE_POSITIVE", 11), (2, day(12)): ("FALSE_NEGATIVE", None), (3, day(12)): ("UNKNOWN", None), (4, day(12)): ("TRUE_NEGATIVE", None),
    }
    told = {r.cutoff: r for r in evaluation.evaluation_metrics(spark.createDataFrame(list(got.values()))).collect()}
    assert (told[day(10)].alert_precision_e4, told[day(10)].call_worthy_rate_e4, told[day(10)].valuation_mae, told[day(10)].downside_failures, told[day(10)].simulated_profitability_total) == (10_000, 5_000, 20, 1, 20)
    with pytest.raises(ValueError):
        evaluation.evaluation_items([(day(10), day(9))], opportunities, deals, values, outcomes)
