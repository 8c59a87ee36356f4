"""Landing of raw records, sources and discovered cards, and delivery of alerts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.operators.opportunity import due_alerts
from hearthline.operators.rows import latest_row


class ListingSource(Protocol):
    """What a source's reader offers: landed pages in, cards and details out, as DataFrames."""

    code: str

    def cards(self, pages: DataFrame) -> DataFrame: ...

    def details(self, pages: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class SourceConfig:
    """A source's registry entry; limits are checked when it is made."""

    code: str
    name: str
    size_min: float = 35
    size_max: float = 90
    markers: tuple[str, ...] = ()
    timeout_s: float = 20
    retries: int = 2
    min_delay_s: float = 0.2
    is_enabled: bool = True
    extra: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.code or self.size_min > self.size_max or self.timeout_s <= 0 or self.retries < 0 or self.min_delay_s < 0:
            raise ValueError(f"source {self.code!r} is not configured")

    def in_scope(self, size: Column, *texts: Column) -> Column:
        """Size within the band and any marker in any of the texts."""
        told = F.lower(F.concat_ws(" ", *texts))
        marked = F.lit(False)
        for m in self.markers:
            marked = marked | told.contains(m)
        return F.coalesce(size.between(self.size_min, self.size_max), F.lit(False)) & marked


def ensure_sources(existing: DataFrame, configs: list[SourceConfig]) -> DataFrame:
    """Registered sources, and those of configs whose code is new."""
    spark = existing.sparkSession
    rows = spark.createDataFrame([(c.code, c.name, c.is_enabled) for c in configs], "code string, name string, is_enabled boolean")
    return existing.select("code", "name", "is_enabled").unionByName(rows.join(existing.select("code"), "code", "left_anti"))


def first_cards(cards: DataFrame) -> DataFrame:
    """One card per external id: the first by market, page and position. What pages of one market repeat
    is dropped with it, so a cycle of pages adds nothing."""
    return latest_row(cards, ["external_id"], [F.asc("market"), F.asc("page"), F.asc("position")])


def landed(records: DataFrame, existing: DataFrame) -> DataFrame:
    """New raw records, one per (listing_id, record_type, content_hash)."""
    keys = ["listing_id", "record_type", "content_hash"]
    hashed = records.withColumn("content_hash", F.sha2(F.col("payload").cast("binary"), 256))
    return hashed.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def deliver_due(alerts: DataFrame, send: Callable[[dict], bool]) -> DataFrame:
    """(alert_id, status, attempts) after one attempt at each due alert. `send` is injected; at most one
    batch (50 rows) is due at a time, which is what goes to the driver."""
    told = []
    for row in due_alerts(alerts).collect():
        try:
            ok = bool(send(row.asDict()))
        except Exception:  # a failed delivery is retried later
            ok = False
        told.append((row["alert_id"], "SENT" if ok else "FAILED", row["attempts"] + 1))
    return alerts.sparkSession.createDataFrame(told, "alert_id long, status string, attempts int")


def expired(files: DataFrame, now: Column, days: int) -> DataFrame:
    """Landed files older than a retention; files has path and modified. A dry run: it only lists them."""
    return files.filter(F.col("modified") < now - F.make_dt_interval(F.lit(days)))
