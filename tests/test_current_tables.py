"""Tables kept current by streams: failures, repeated batches, late rows, untouched partitions."""

from __future__ import annotations

import datetime
import os
import random
import tempfile

import pytest

from hearthline.streaming import jobs
from hearthline.streaming.current import CurrentListings, IncrementalAnalysis, KeyedTable

rnd = random.Random(8)
minute = lambda k: datetime.datetime(2024, 3, 1) + datetime.timedelta(minutes=k)
SCHEMA = "user_id long, ts timestamp, event_id long, price long"


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="hearthline-test-")


def plain(batches):
    """Table, changes and late rows by going through the batches one row at a time."""
    state, changes, late = {}, [], []
    for batch in batches:
        before = dict(state)
        for user, ts, ident, price in sorted(batch, key=lambda r: (r[1], r[2])):
            if user in before and (ts, ident) <= before[user][:2]:
                late.append((user, ident, "REPEATED" if (ts, ident) == before[user][:2] else "LATE"))
                continue
            if user in state:
                old = state[user]
                if old[2] != price:
                    changes.append((user, ident, old[2], price))
                state[user] = (ts, ident, price, old[3], old[4] + (old[2] != price))
            else:
                state[user] = (ts, ident, price, ts, 0)
    return state, sorted(changes), sorted(late)


def told(listings):
    table = {r.user_id: (r.last_seen, r.event_id, r.price, r.first_seen, r.n_changes) for r in listings.table.current().collect()}
    changes = sorted((r.user_id, r.event_id, r.old_value, r.new_value) for r in listings.changes().collect())
    return table, changes, sorted((r.user_id, r.event_id, r.reason) for r in listings.late().collect())


def test_batches_that_fail_and_run_again(spark, folder, monkeypatch):
    rows = [(rnd.randrange(12), minute(k + rnd.randrange(-40, 1)), k, rnd.randrange(4)) for k in range(300)]
    batches = [rows[:100], rows[100:200] + rows[90:95], rows[200:]]
    frames = [spark.createDataFrame(b, SCHEMA) for b in batches]
    listings = CurrentListings(spark, folder, "user_id", "ts", "event_id", "price", buckets=4)
    listings.apply(frames[0], 0)
    real = KeyedTable.upsert

    def fails_first(self, changed, batch, done=None):
        raise OSError("lost before the table was written")

    def fails_halfway(self, changed, batch, done=None):
        real(self, changed.filter(self.bucket() < 2), batch, done)
        raise OSError("lost after two partitions")

    for broken in (fails_first, fails_halfway):
        monkeypatch.setattr(KeyedTable, "upsert", broken)
        with pytest.raises(OSError):
            listings.apply(frames[1], 1)
    monkeypatch.setattr(KeyedTable, "upsert", real)
    listings.apply(frames[1], 1)
    listings.apply(frames[1], 1)  # done already: nothing happens twice
    listings.apply(frames[2], 2)
    assert told(listings) == plain(batches)


def test_untouched_partitions_are_not_rewritten(spark, folder):
    table = KeyedTable(spark, f"{folder}/t", "k", "v long", buckets=8)
    table.upsert(spark.createDataFrame([(k, k) for k in range(100)], "k long, v long"), 0)
    files = lambda: {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(f"{folder}/t") for f in fs if f.startswith("part-")}
    before = files()
    table.upsert(spark.createDataFrame([(5, 500)], "k long, v long"), 1)
    assert {r.k: r.v for r in table.current().collect()} == {k: k if k != 5 else 500 for k in range(100)}
    assert len(set(before.items()) - set(files().items())) == 1


def test_two_runs_of_a_stream(spark, folder):
    rows = [(rnd.randrange(5), minute(k), k, rnd.randrange(3)) for k in range(80)]
    batches = [rows[:40], rows[40:] + [(1, minute(-5), 900, 7), (None, minute(1), 901, 1), (2, None, 902, 1)]]
    listings = CurrentListings(spark, folder, "user_id", "ts", "event_id", "price", buckets=3)
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/landed")
        listings.run_available(spark.readStream.schema(SCHEMA).parquet(f"{folder}/landed"))
    assert told(listings) == plain([[r for r in b if None not in r] for b in batches])


def test_only_touched_properties_are_analysed(spark, folder):
    asked = []

    def analyse(keys):
        found = keys.filter("property_id <> 3")
        asked.append({r.property_id for r in keys.collect()})
        return found.selectExpr("property_id", "'CALL' AS action", "property_id * 10 AS score")

    event = "property_id long, event_id long, event_type string, at timestamp"
    analysis = IncrementalAnalysis(spark, folder, analyse, buckets=4)
    analysis.apply(spark.createDataFrame([(1, 1, "PRICE_CHANGED", minute(1)), (3, 2, "SELLER_CHANGED", minute(2)), (4, 3, "DISCOVERED", minute(3))], event), 0)
    analysis.apply(spark.createDataFrame([(1, 4, "DESCRIPTION_CHANGED", minute(9)), (5, 5, "PRICE_CHANGED", minute(8))], event), 1)
    assert asked == [{1, 3}, {1, 5}]
    got = {r.property_id: (r.llm_status, r.risk_status, r.deal_status, r.action, r.n_runs) for r in analysis.table.current().collect()}
    assert got == {1: ("STALE", "SUCCESS", "SUCCESS", "CALL", 2), 3: ("NOT_RUN", "INSUFFICIENT_DATA", "INSUFFICIENT_DATA", None, 1), 5: ("NOT_RUN", "NOT_RUN", "SUCCESS", "CALL", 1)}


def test_late_scans_and_late_alerts_are_told_apart(spark, folder):
    scan = "user_id long, scan_id long, seen boolean, ts timestamp"
    runs = [[(1, 1, True, minute(1)), (1, 3, False, minute(3))], [(1, 2, False, minute(2)), (1, 4, False, minute(4))]]
    for rows in runs:
        spark.createDataFrame(rows, scan).coalesce(1).write.mode("append").parquet(f"{folder}/scans")
        out = jobs.run_available(jobs.miss_counts(spark.readStream.schema(scan).parquet(f"{folder}/scans"), "user_id", "ts"), f"{folder}/misses")
    assert {r.scan_id: (r.misses, r.status) for r in out.collect()} == {1: (0, "ACTIVE"), 3: (1, "NOT_SEEN"), 2: (None, "LATE"), 4: (2, "NOT_SEEN")}
    event = "user_id long, ts timestamp, event_id long"
    for rows in ([(1, minute(0), 1), (1, minute(500), 2)], [(1, minute(100), 3), (1, minute(900), 4), (1, minute(870), 5)]):
        spark.createDataFrame(rows, event).coalesce(1).write.mode("append").parquet(f"{folder}/events")
        out = jobs.run_available(jobs.cooled_alerts(spark.readStream.schema(event).parquet(f"{folder}/events"), "user_id", "ts", "event_id"), f"{folder}/alerts")
    assert {r.event_id: r.late for r in out.collect()} == {1: False, 2: False, 3: True, 5: False}
