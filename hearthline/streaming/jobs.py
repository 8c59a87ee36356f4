"""Incremental jobs as Structured Streaming: price diffs, watch triggers, misses, cooldowns, dedupe.

Each job takes a streaming DataFrame and gives one; run_available() drives it over what is there into a
Parquet sink and returns the rows. Event time has a watermark, and the state of a key goes once it has been
silent for `keep` beyond it, so that state is bounded: a key that comes back later starts anew."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hearthline.operators.workflow import rule_fires


def run_available(out: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All rows that the stream gives for what its source holds now; folder is a shared one."""
    query = out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{folder}/rows")


DAY_MS = 86_400_000


def _expires(state: GroupState, newest_micros: int, keep_days: int) -> None:
    """Set when a key's state goes: keep_days after its newest event, and never before the watermark."""
    state.setTimeoutTimestamp(max(newest_micros // 1000, state.getCurrentWatermarkMs()) + keep_days * DAY_MS)


def price_changes(events: DataFrame, key: str, at: str, ident: str, value: str, delay: str = "1 day", keep_days: int = 400) -> DataFrame:
    """(key, ident, at, old_value, new_value, late): an observation whose value differs from the last one seen.

    The state is the last value and its time. Rows of a batch are taken in order of time; one that is older
    than what an earlier batch has seen comes out with late set and without values, for a table of its own.
    What is older than the watermark Spark drops, and counts (numRowsDroppedByWatermark); CurrentListings in current.py
    keeps them in a table."""
    schema = f"{key} long, {ident} long, {at} timestamp, old_value long, new_value long, late boolean"

    def diff(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values([at, ident])
        last, seen = state.get if state.exists else (None, None)
        micros = rows[at].astype("datetime64[us]").astype("int64").to_numpy()
        late = micros < seen if seen is not None else np.zeros(len(rows), bool)
        for is_late in (True, False):
            part = rows[late == is_late]
            before = part[value].shift(1)
            if not is_late and len(part) and last is not None:
                before.iloc[0] = last
            moved = np.ones(len(part), bool) if is_late else (before.notna() & (before != part[value])).to_numpy()
            told = (lambda x: pd.array([pd.NA] * int(moved.sum()), "Int64")) if is_late else (lambda x: x[moved].astype("Int64").array)
            yield pd.DataFrame({key: group[0], ident: part[ident][moved].array, at: part[at][moved].array, "old_value": told(before), "new_value": told(part[value]), "late": is_late})
        fresh = rows[~late]
        if len(fresh):
            last, seen = int(fresh[value].iloc[-1]), int(micros[~late][-1])
            state.update((last, seen))
        _expires(state, seen, keep_days)

    timed = events.withWatermark(at, delay)
    return timed.groupBy(key).applyInPandasWithState(diff, schema, "last long, seen long", "append", GroupStateTimeout.EventTimeTimeout)


def watch_triggers(changes: DataFrame, rules: DataFrame, key: str, at: str, ident: str, delay: str = "1 day") -> DataFrame:
    """Rules met by price changes, each rule and change once."""
    met = changes.withWatermark(at, delay).join(rules.filter("is_active"), key)
    met = met.filter(rule_fires(F.col("rule_type"), F.col("threshold"), F.col("old_value"), F.col("new_value")))
    return met.select(key, "rule_id", ident, at).dropDuplicatesWithinWatermark(["rule_id", ident])


def windowed_counts(events: DataFrame, at: str, keys: list[str], length: str = "7 days", step: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts in sliding windows, given out once a window is complete."""
    return events.withWatermark(at, delay).groupBy(F.window(at, length, step), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def distinct_records(records: DataFrame, at: str, content: Column, delay: str = "1 day") -> DataFrame:
    """The first record of each content within the watermark."""
    return records.withColumn("content_hash", F.sha2(content.cast("binary"), 256)).withWatermark(at, delay).dropDuplicatesWithinWatermark(["content_hash"])


def cooled_alerts(events: DataFrame, key: str, at: str, ident: str, seconds: int = 21600, delay: str = "1 day") -> DataFrame:
    """(key, ident, at, late) of events at least `seconds` after the key's last alert; the state is its time and that of
    the newest event, and goes when the cooldown is over beyond the watermark. Events older than what an earlier batch
    has seen come out marked late, for a table of their own, and raise no alert."""

    def cool(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values([at, ident])
        micros = rows[at].astype("datetime64[us]").astype("int64").to_numpy()
        last, seen = state.get if state.exists else (None, None)
        late = micros < seen if seen is not None else np.zeros(len(rows), bool)
        if late.any():
            yield pd.DataFrame({key: group[0], ident: rows[ident][late].array, at: rows[at][late].array, "late": True})
        rows, micros, told = rows[~late], micros[~late], []
        if not len(rows):
            state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + seconds * 1000 + 1)
            return
        k = 0 if last is None else int(np.searchsorted(micros, last + seconds * 1_000_000))
        while k < len(micros):
            told.append(k)
            last = int(micros[k])
            k = int(np.searchsorted(micros, last + seconds * 1_000_000))
        state.update((last, int(micros[-1])))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + seconds * 1000 + 1)
        yield pd.DataFrame({key: group[0], ident: rows[ident].iloc[told].array, at: rows[at].iloc[told].array, "late": False})

    timed = events.withWatermark(at, delay)
    return timed.groupBy(key).applyInPandasWithState(cool, f"{key} long, {ident} long, {at} timestamp, late boolean", "last long, seen long", "append", GroupStateTimeout.EventTimeTimeout)


def miss_counts(scans: DataFrame, key: str, at: str, delay: str = "1 day", keep_days: int = 400) -> DataFrame:
    """(key, scan_id, misses, status): consecutive misses after each scan (scan_id, key, seen, at); one miss is
    NOT_SEEN, a sighting resets. A scan no later than one that an earlier batch has counted comes out as LATE, without
    misses, and changes nothing."""

    def count(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("scan_id")
        before, last = state.get if state.exists else (0, None)
        newest = int(rows[at].astype("datetime64[us]").astype("int64").max())
        late = (rows["scan_id"] <= last).to_numpy() if last is not None else np.zeros(len(rows), bool)
        if late.any():
            yield pd.DataFrame({key: group[0], "scan_id": rows["scan_id"][late].array, "misses": pd.array([pd.NA] * int(late.sum()), "Int64"), "status": "LATE"})
        rows = rows[~late]
        if not len(rows):
            _expires(state, newest, keep_days)
            return
        seen = rows["seen"].to_numpy(bool)
        place = np.arange(1, len(seen) + 1)
        sighted = np.maximum.accumulate(np.where(seen, place, 0))
        misses = place - sighted + np.where(sighted == 0, before, 0)
        state.update((int(misses[-1]), int(rows["scan_id"].iloc[-1])))
        _expires(state, newest, keep_days)
        yield pd.DataFrame({key: group[0], "scan_id": rows["scan_id"].array, "misses": misses, "status": np.where(misses > 0, "NOT_SEEN", "ACTIVE")})

    timed = scans.withWatermark(at, delay)
    return timed.groupBy(key).applyInPandasWithState(count, f"{key} long, scan_id long, misses long, status string", "misses long, last long", "append", GroupStateTimeout.EventTimeTimeout)

