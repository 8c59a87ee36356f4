"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder. Where none is set, a local master gets a temporary one (tests);
    on a cluster that is an error, since its executors share no local folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="hearthline-")
    sc.setCheckpointDir(folder)


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there, so that branches share one
    computation and a lost executor costs no more than a re-read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df, written compressed to the shared checkpoint folder and read from there, and where it is."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove what stored() has written, once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): the columns an operator needs, a null text read as an empty one.

    th is a hash of the text. (doc_id, th) names a row up to exact repetition, which is all that
    the duplicate operators need: repeated rows have the same spans.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def whole_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, th, row): the key of keyed() beside the row itself, so that no name of docs clashes with
    a column of an operator's own; select("row.*") gives docs again."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.struct("*").alias("row"))


def hold_few_rows(spark: SparkSession, most: int) -> None:
    """From now on Spark hands its Python workers at most so many rows at a time. A batch lies in Arrow on both
    sides and as values between, in and out, in every task of an executor; results don't depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= most:  # 0 and less: no limit
        spark.conf.set(key, most)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
