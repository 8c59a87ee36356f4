"""Tables that a stream keeps current: keyed upserts of the touched partitions alone, late rows apart, re-analysis of
the touched keys alone. Batches may be run again after a failure at any point; they then change nothing twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthline.operators.rows import ensure_checkpoint_dir
from hearthline.operators.workflow import INVALIDATES, stale_modules

# Modules that an invalidated one is not run again with (their results come from outside).
NOT_RERUN = ["llm"]


class KeyedTable:
    """One row per key in Parquet, in `buckets` partitions by a hash of the key. An upsert rewrites the partitions of its
    keys and no others; each row holds the number of the batch that wrote it."""

    def __init__(self, spark: SparkSession, path: str, key: str, columns: str, buckets: int = 64):
        ensure_checkpoint_dir(spark)
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = f"{key} long, {columns}, _batch long, _bucket int"
        spark.createDataFrame([], self.schema).write.mode("ignore").partitionBy("_bucket").parquet(path)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def current(self) -> DataFrame:
        return self.rows().drop("_batch", "_bucket")

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows of keys, read from their partitions alone."""
        touched = [r[0] for r in keys.select(self.bucket()).distinct().collect()]
        return self.rows().filter(F.col("_bucket").isin(touched)).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def applied(self, keys: DataFrame, batch: int) -> list[int]:
        """Partitions of these keys that this batch has rewritten already."""
        touched = [r[0] for r in keys.select(self.bucket()).distinct().collect()]
        return [r[0] for r in self.rows().filter(F.col("_bucket").isin(touched) & (F.col("_batch") == batch)).select("_bucket").distinct().collect()]

    def upsert(self, changed: DataFrame, batch: int, done: list[int] | None = None) -> None:
        """Put changed (a whole row per key) in, but for partitions that are done. The new partitions are written out
        first, since they come from those that they replace."""
        new = changed.withColumns({"_batch": F.lit(batch).cast("long"), "_bucket": self.bucket()}).filter(~F.col("_bucket").isin(done or []))
        new = new.select(*self.rows().columns).checkpoint()
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]
        if not touched:
            return
        kept = self.rows().filter(F.col("_bucket").isin(touched)).join(new.select(self.key), self.key, "left_anti")
        whole = kept.unionByName(new).checkpoint()
        whole.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)


def batch_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What all batches have written to a table of one folder a batch."""
    spark.createDataFrame([], f"{schema}, batch long").write.mode("ignore").partitionBy("batch").parquet(path)
    return spark.read.schema(f"{schema}, batch long").parquet(path)


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


class CurrentListings:
    """Listings kept current from a stream of observations (key, at, ident, value): table, with the last value, when it
    was first and last seen and how often it changed; changes; and late rows.

    A batch's rows of a key are taken in order of (at, ident) after the key's last one. What is no later than that goes
    to the late table: REPEATED for the very last one, LATE otherwise. Nothing is dropped. A key's rows of a batch are
    sorted by Spark, which spills; maxFilesPerTrigger of the source bounds a batch."""

    def __init__(self, spark: SparkSession, folder: str, key: str, at: str, ident: str, value: str, buckets: int = 64):
        self.spark, self.key, self.at, self.ident, self.value = spark, key, at, ident, value
        self.table = KeyedTable(spark, f"{folder}/current", key, f"{value} long, {ident} long, first_seen timestamp, last_seen timestamp, n_changes long", buckets)
        self.changes_at, self.late_at, self.state = f"{folder}/changes", f"{folder}/late", f"{folder}/state"

    def changes(self) -> DataFrame:
        return batch_rows(self.spark, self.changes_at, f"{self.key} long, {self.ident} long, {self.at} timestamp, old_value long, new_value long")

    def late(self) -> DataFrame:
        return batch_rows(self.spark, self.late_at, f"{self.key} long, {self.ident} long, {self.at} timestamp, {self.value} long, reason string")

    def apply(self, batch: DataFrame, number: int) -> None:
        """One micro-batch: changes and late rows first, the table last, so that a repeated run finds what is done."""
        c = F.col
        rows = batch.filter(c(self.key).isNotNull() & c(self.at).isNotNull()).select(self.key, self.at, self.ident, self.value).checkpoint()
        done = self.table.applied(rows, number)
        old = self.table.of(rows).select(self.key, c("last_seen"), c(self.ident).alias("_ident"), c(self.value).alias("_value"), "first_seen", "n_changes")
        both = rows.join(old, self.key, "left")
        place, last = F.struct(c(self.at).alias("a"), c(self.ident).alias("i")), F.struct(c("last_seen").alias("a"), c("_ident").alias("i"))
        is_late = F.coalesce(place <= last, F.lit(False)) & c("last_seen").isNotNull()
        along = Window.partitionBy(self.key).orderBy(self.at, self.ident)
        steps = both.filter(~is_late).withColumn("_before", F.coalesce(F.lag(self.value).over(along), c("_value")))
        steps = steps.withColumn("_moved", F.coalesce(c("_before") != c(self.value), F.lit(False))).checkpoint()
        if not done:
            write_batch(steps.filter("_moved").select(self.key, self.ident, self.at, c("_before").alias("old_value"), c(self.value).alias("new_value")), self.changes_at, number)
            write_batch(both.filter(is_late).select(self.key, self.ident, self.at, self.value, F.when(place == last, "REPEATED").otherwise("LATE").alias("reason")), self.late_at, number)
        newest = steps.groupBy(self.key).agg(
            F.max(F.struct(self.at, self.ident, self.value)).alias("m"), F.min(F.coalesce("first_seen", self.at)).alias("first_seen"),
            (F.coalesce(F.max("n_changes"), F.lit(0)) + F.count_if("_moved")).alias("n_changes"),
        )
        self.table.upsert(newest.select(self.key, c(f"m.{self.value}").alias(self.value), c(f"m.{self.ident}").alias(self.ident), "first_seen", c(f"m.{self.at}").alias("last_seen"), "n_changes"), number, done)

    def run_available(self, observations: DataFrame) -> None:
        """All that the stream holds now; the next run goes on from there."""
        observations.writeStream.foreachBatch(self.apply).option("checkpointLocation", self.state).trigger(availableNow=True).start().awaitTermination()


class IncrementalAnalysis:
    """Module states and decisions of properties, kept current from events (property_id, event_id, event_type, at).

    A batch's events make modules of their properties stale. analyse(keys) computes the decision (property_id, action,
    score) of these properties alone, from inputs that it restricts to them; what it leaves out has insufficient data.
    Modules that come from outside stay STALE until they are marked."""

    MODULES = sorted({m for ms in INVALIDATES.values() for m in ms})

    def __init__(self, spark: SparkSession, folder: str, analyse: Callable[[DataFrame], DataFrame], buckets: int = 64):
        self.spark, self.analyse, self.state = spark, analyse, f"{folder}/state"
        columns = ", ".join([*(f"{m}_status string" for m in self.MODULES), "action string", "score long", "analysed_at timestamp", "n_runs long"])
        self.table = KeyedTable(spark, f"{folder}/states", "property_id", columns, buckets)

    def apply(self, batch: DataFrame, number: int) -> None:
        c = F.col
        events = batch.filter("property_id is not null").withColumn("module", F.explode(stale_modules(c("event_type"))))
        stale = events.groupBy("property_id").agg(F.collect_set("module").alias("modules"), F.max("at").alias("at")).checkpoint()
        done = self.table.applied(stale, number)
        fresh = self.analyse(stale.select("property_id")).select("property_id", c("action").alias("_action"), c("score").alias("_score"), F.lit(True).alias("_found"))
        both = stale.join(self.table.of(stale).drop("_batch", "_bucket"), "property_id", "left").join(fresh, "property_id", "left")
        told = lambda m: F.lit("STALE") if m in NOT_RERUN else F.when(c("_found"), "SUCCESS").otherwise("INSUFFICIENT_DATA")
        states = {f"{m}_status": F.when(F.array_contains("modules", m), told(m)).otherwise(F.coalesce(f"{m}_status", F.lit("NOT_RUN"))) for m in self.MODULES}
        new = both.withColumns(states | {"action": c("_action"), "score": c("_score").cast("long"), "analysed_at": F.greatest("analysed_at", "at"), "n_runs": F.coalesce("n_runs", F.lit(0)) + 1})
        self.table.upsert(new.drop("modules", "at", "_action", "_score", "_found"), number, done)

    def run_available(self, events: DataFrame) -> None:
        events.writeStream.foreachBatch(self.apply).option("checkpointLocation", self.state).trigger(availableNow=True).start().awaitTermination()
