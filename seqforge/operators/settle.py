"""Results that several later steps read: computed once, kept in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own where a local session names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="seqforge-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/seqforge-{uuid.uuid4().hex}/{name}"


_written: list[str] = []


def settled(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: neither its plan nor its work is repeated by each reader, and a
    lost executor takes nothing with it. The files stay until clear."""
    path = new_path(df.sparkSession, "settled")
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all that settled has written in this session: for between queries, when no result of one is read any more."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop()).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for a broadcast if it has so many rows at most; count what is settled."""
    return F.broadcast(df) if df.count() <= rows else df
