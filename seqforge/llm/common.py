"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the class [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = "[ \\t\\n\\x0B\\f\\r]+"

#: Bytes of a batch of rows that goes to Python, and of the texts that a kernel takes at a time; one longer text is
#: a batch of its own.
BATCH_BYTES = 4 << 20
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="seqforge-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, name: str = "t", compression: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: what follows doesn't recompute it, whichever executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seqforge-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow in batches of BATCH_BYTES, whatever the rows' size: a task's memory doesn't grow with its texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(f, schema)


def chunks(batches: Iterator[pa.RecordBatch], *cols: str, most: int = 1000) -> Iterator[pa.RecordBatch]:
    """The rows of batches in pieces whose texts in cols have about CHUNK_BYTES, of most rows at most."""
    for b in batches:
        at = size = 0
        lengths = sum(pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in cols)
        for i, n in enumerate(lengths):
            if i > at and (size + n > CHUNK_BYTES or i - at >= most):
                yield b.slice(at, i - at)
                at, size = i, 0
            size += n
        if at < b.num_rows:
            yield b.slice(at)


def hash128(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes, h1 and h2; equal pairs count as equal values."""
    return [F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit(7), *cols).alias("h2")]


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
