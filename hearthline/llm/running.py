"""Distributed prefix sums: rows are sorted over ranges, each task sums its own range, and the totals of the ranges
before it, one row a partition, are added. No order's rows ever meet in one task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import discard, shuffle_partitions, stored


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str]) -> tuple[DataFrame, str]:
    """df with an inclusive running sum of a long column of it for each (name, column) of sums, along order, and
    where it is stored. Rows that order cannot tell apart go to one task: give an id last. Nulls count as zero."""
    spark, parts = df.sparkSession, shuffle_partitions(df.sparkSession)
    names, columns = [*sums], [*sums.values()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, pid = [0] * len(columns), TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for k, c in enumerate(columns):
                along = np.cumsum(batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)) + total[k]
                total[k] = int(along[-1]) if len(along) else total[k]
                out.append(pa.array(along, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out, pa.array([pid] * batch.num_rows, pa.int32())], [*batch.schema.names, *names, "_pid"])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"{n} long" for n in names), "_pid int"])
    local, local_at = stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, fields))
    totals = sorted(local.groupBy("_pid").agg(*(F.sum(c).alias(n) for n, c in sums.items())).collect())
    before = [[0, *accumulate((r[n] or 0 for r in totals))] for n in names]
    rows = [(r["_pid"], *(b[k] for b in before)) for k, r in enumerate(totals)]
    offsets = spark.createDataFrame(rows, ", ".join(["_pid int", *(f"_{n} long" for n in names)]))
    out, at = stored(local.join(F.broadcast(offsets), "_pid").select(*df.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in names)))
    discard(spark, local_at)
    return out, at
