"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid
from collections.abc import Callable

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path in the folder that the session's spark.checkpoint.dir names; only where there is none, as in tests on one machine, one is made and set."""
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


_KEPT: dict[tuple, DataFrame] = {}


def stamp(sf_dir: str, tables: tuple[str, ...]) -> tuple:
    """Name, size and time of each file of the tables."""
    root = re.sub("^file:/+", "file:///", sf_dir) if ":" in sf_dir.split("/")[0] else "file://" + posixpath.abspath(sf_dir)
    fs, base = pafs.FileSystem.from_uri(root)
    out = []
    for t in tables:
        own = fs.get_file_info(f"{base}/{t}.parquet")
        files = [own] if own.is_file else fs.get_file_info(pafs.FileSelector(own.path, recursive=True, allow_not_found=True))
        out += sorted((x.path, x.size, x.mtime_ns) for x in files)
    return tuple(out)


def kept(spark: SparkSession, sf_dir: str, what: str, tables: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
    """What build gives, stored once for a session and these files of the tables, so that all searches over them share it."""
    key = (spark.sparkContext.applicationId, what, stamp(sf_dir, tables))
    if key not in _KEPT:
        _KEPT[key] = stored(build(), what)
    return _KEPT[key]


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet and read again: what several branches of a plan need is computed once, and outlives executors."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
