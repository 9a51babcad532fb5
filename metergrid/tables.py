"""Tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. A session on one machine (tests, notebooks) that has none gets a temporary
    folder, set once and kept for the session; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.metergrid.scratch", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="metergrid-")
        spark.conf.set("spark.metergrid.scratch", found)
    return found


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, for results that are read later: it stays until the process ends."""
    return lasting(df.sparkSession).written(df, name, partition_by)


def _stored(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run in the shared folder. drop() deletes one after its last use, the end of the run all of them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, shared_dir(spark)
        self.paths: dict[DataFrame | str, str] = {}

    def written(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        out = _stored(df, path, partition_by)
        self.paths[out] = path
        return out

    def folder_of(self, name: str) -> str:
        """A new path, whose folder is deleted with the tables."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        self.paths[path] = path
        return path

    def drop(self, *tables: DataFrame | str) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(table))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.drop(*list(self.paths))


_lasting: dict[str, Scratch] = {}


def lasting(spark: SparkSession) -> Scratch:
    """Tables that a lazy result still reads when its function returns. The end of the process deletes them, if it is a
    regular one; else whoever owns the shared folder does."""
    if spark.sparkContext.applicationId not in _lasting:
        _lasting[spark.sparkContext.applicationId] = held = Scratch(spark)
        atexit.register(_end, held)
    return _lasting[spark.sparkContext.applicationId]


def _end(held: Scratch) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        held.drop(*list(held.paths))
