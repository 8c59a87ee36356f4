"""Delivery of alerts by tasks, once for each dedupe key, over failures and repeated batches.

A task leaves a claim (a small file named by the key's hash, in the shared folder) before it sends an alert and a receipt
after it. A batch that is run again skips what has a receipt. What has a claim alone may have gone out: it is told
as UNCERTAIN and not sent again, since a second call is worse than a late one; release() lets it go once somebody has
looked. Alerts that a sender refuses are FAILED and tried again in later batches, MOST_ATTEMPTS times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.operators.opportunity import MOST_ATTEMPTS
from hearthline.operators.rows import latest_row

LEDGER = "dedupe_key string, status string, attempts int, error string"


class Marks:
    """Claims and receipts of dedupe keys in a shared folder."""

    def __init__(self, folder: str):
        self.folder = folder

    def _at(self, key: str, kind: str) -> tuple[fs.FileSystem, str]:
        files, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        digest = hashlib.sha256(key.encode()).hexdigest()
        return files, f"{root}/{kind}/{digest[:2]}/{digest}"

    def has(self, key: str, kind: str) -> bool:
        files, name = self._at(key, kind)
        return files.get_file_info(name).type == fs.FileType.File

    def put(self, key: str, kind: str) -> None:
        files, name = self._at(key, kind)
        files.create_dir(name.rpartition("/")[0], recursive=True)
        with files.open_output_stream(name) as f:
            f.write(key.encode())

    def drop(self, key: str, kind: str) -> None:
        files, name = self._at(key, kind)
        if files.get_file_info(name).type == fs.FileType.File:
            files.delete_file(name)


class Outbox:
    """Alerts (dedupe_key and what the sender reads) delivered by `send`, a function of a row as a dict that returns
    whether it went out. The ledger has a folder a batch; its latest row of a key is the key's state."""

    def __init__(self, spark, folder: str, send: Callable[[dict], bool]):
        self.spark, self.folder, self.send, self.marks = spark, folder, send, Marks(f"{folder}/marks")

    def ledger(self) -> DataFrame:
        schema = f"{LEDGER}, batch long"
        self.spark.createDataFrame([], schema).write.mode("ignore").partitionBy("batch").parquet(f"{self.folder}/ledger")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/ledger")

    def states(self) -> DataFrame:
        """The last state of every key."""
        return latest_row(self.ledger(), ["dedupe_key"], [F.desc("batch")])

    def pending(self, alerts: DataFrame) -> DataFrame:
        """Alerts still to be sent, one a key, with the attempts so far."""
        once = alerts.filter("dedupe_key is not null").dropDuplicates(["dedupe_key"])
        seen = self.states().select("dedupe_key", F.col("status").alias("_status"), F.col("attempts").alias("_attempts"))
        left = once.join(seen, "dedupe_key", "left").filter("_status is null or _status = 'FAILED'").withColumn("_attempts", F.coalesce("_attempts", F.lit(0)))
        return left.filter(F.col("_attempts") < MOST_ATTEMPTS).drop("_status")

    def apply(self, alerts: DataFrame, batch: int) -> None:
        """One batch: what is pending is sent by the tasks that hold it, and their reports are the batch's ledger."""
        marks, send = self.marks, self.send

        def deliver(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                told = []
                for row in frame.to_dict("records"):
                    key, attempts = row["dedupe_key"], row.pop("_attempts")
                    if marks.has(key, "sent"):
                        told.append((key, "SENT", attempts + 1, None))
                        continue
                    if marks.has(key, "claimed"):
                        told.append((key, "UNCERTAIN", attempts + 1, "claimed by a task that did not report"))
                        continue
                    marks.put(key, "claimed")
                    try:
                        ok, error = bool(send(row)), None
                    except Exception as e:  # the sender says that it did not go out
                        ok, error = False, f"{type(e).__name__}: {e}"[:500]
                    marks.put(key, "sent") if ok else marks.drop(key, "claimed")
                    told.append((key, "SENT" if ok else "FAILED", attempts + 1, error))
                yield pd.DataFrame(told, columns=["dedupe_key", "status", "attempts", "error"])

        failed = self.ledger().filter(F.col("batch") == batch)
        if not failed.isEmpty():
            return  # the batch is in the ledger: it went through before
        report = self.pending(alerts).mapInPandas(deliver, LEDGER)
        report.write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch}")

    def release(self, keys: DataFrame) -> None:
        """Uncertain keys that turned out unsent: their claims go, and a ledger row lets them be tried again."""
        found = self.states().filter("status = 'UNCERTAIN'").join(keys.select("dedupe_key").distinct(), "dedupe_key", "left_semi")
        marks = self.marks

        def freed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for key in frame["dedupe_key"]:
                    marks.drop(key, "claimed")
                yield frame.assign(status="FAILED", error="released")[["dedupe_key", "status", "attempts", "error"]]

        batch = (self.ledger().agg(F.max("batch")).first()[0] or 0) + 1
        found.mapInPandas(freed, LEDGER).write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch}")

    def run_available(self, alerts: DataFrame) -> None:
        alerts.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start().awaitTermination()
