"""What the operators of this folder share: tables, fresh column names, the cluster's shared folder, sizes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_ID = "null ids"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share.

    It lies in ``spark.checkpoint.dir``; only where the session has none and runs on
    one machine, as in tests, one is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarrylake-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: it cuts the lineage and outlives executors."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_fields(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    out = T.StructType(list(df.schema.fields))
    for name, kind in fields:
        out = out.add(name, kind, True)
    return out


def parts(spark: SparkSession) -> int:
    """Buckets for packed exchanges: as many as the session has shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucket_count(spark: SparkSession, size: float, each: int) -> int:
    """Buckets for a packed exchange of so many bytes, so that none has much more than each; two for each core at least."""
    return max(2 * spark.sparkContext.defaultParallelism, int(size // each) + 1)


def bucket_ids(n: int) -> np.ndarray:
    """n numbers of which Spark's hash puts one into each of n partitions: repartition(n, "bucket") then has a bucket in each."""
    i = np.arange(40 * n + 40, dtype=np.uint32)
    turn = lambda x, k: (x << np.uint32(k)) | (x >> np.uint32(32 - k))
    h = turn(turn(i * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593) ^ np.uint32(42), 13) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(by)
    part = np.mod(h.view(np.int32).astype(np.int64), n)
    out = np.arange(n, dtype=np.int32) + np.int32(len(i))  # for a partition that none of these finds
    out[part[::-1]] = i[::-1].astype(np.int32)
    return out


def as_id(df: DataFrame, column: str = "doc_id"):
    return F.col(column).cast("bigint")
