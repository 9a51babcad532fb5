"""Cursor's usage as a snapshot with two halves: what counts, and what is parked.

Usage comes from the cloud or from billing exports, never from both at once. A refresh from the cloud makes the cloud's events
active, an import makes the billing items active; the other half is parked with its events, and its ids are withdrawn, until
a switch back restores it. Ids that count are never withdrawn. A snapshot is stored in versions; a version counts once it is
complete, and readers take the last one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLOUD, BILLING = "cloud", "billing"
ACTIVE, PARKED, WITHDRAWN = "active", "parked", "withdrawn"


@dataclass(frozen=True)
class Snapshot:
    """events: what counts; parked: the other source's; withdrawn: (id)."""

    source: str
    events: DataFrame
    parked: DataFrame
    withdrawn: DataFrame


def empty(spark: SparkSession, schema: T.StructType) -> Snapshot:
    none = spark.createDataFrame([], schema)
    return Snapshot(CLOUD, none, none, none.select("id"))


def _halves(previous: Snapshot, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the source had before, what the other one has, and the ids withdrawn so far, with those of a half that is left."""
    if previous.source == source:
        return previous.events, previous.parked, previous.withdrawn
    return previous.parked, previous.events, previous.withdrawn.union(previous.events.select("id"))


def _made(source: str, events: DataFrame, parked: DataFrame, withdrawn: DataFrame) -> Snapshot:
    return Snapshot(source, events, parked, withdrawn.distinct().join(events.select("id"), "id", "left_anti"))


def refreshed(previous: Snapshot, fresh: DataFrame, agents: DataFrame) -> Snapshot:
    """After a read of the cloud. Of agents (session_id) that were read again only the fresh events stay; those of others are
    kept, since that they are missing proves nothing."""
    before, parked, withdrawn = _halves(previous, CLOUD)
    again = agents.select("session_id").distinct()
    events = fresh.unionByName(before.join(again, "session_id", "left_anti").select(*fresh.columns))
    return _made(CLOUD, events, parked, withdrawn.union(before.join(again, "session_id", "left_semi").select("id")))


def imported(previous: Snapshot, items: DataFrame) -> Snapshot:
    """After an import of billing items, which are added to those of earlier imports or replace them by id."""
    before, parked, withdrawn = _halves(previous, BILLING)
    events = items.unionByName(before.join(items.select("id"), "id", "left_anti").select(*items.columns))
    return _made(BILLING, events, parked, withdrawn)


def _versions(spark: SparkSession, path: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    there = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(int(n.removeprefix("version-")) for n in names if n.startswith("version-") and there(n))


def write(spark: SparkSession, path: str, snapshot: Snapshot) -> None:
    """A new version in one write: all parts, or none."""
    half = lambda df, name: df.withColumns({"half": F.lit(name), "source": F.lit(snapshot.source)})
    gone = snapshot.withdrawn.select("id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in snapshot.events.schema if f.name != "id"])
    mark = gone.limit(0).unionByName(spark.createDataFrame([("",)], "id string"), allowMissingColumns=True)  # the source, where there is no row
    rows = half(snapshot.events, ACTIVE).unionByName(half(snapshot.parked, PARKED)).unionByName(half(gone, WITHDRAWN)).unionByName(half(mark, "mark"))
    number = (_versions(spark, path) or [0])[-1] + 1
    rows.write.mode("overwrite").parquet(f"{path}/version-{number:08d}")


def read(spark: SparkSession, path: str, schema: T.StructType) -> Snapshot:
    """The last complete version; an empty snapshot if there is none. Files whose columns have other types are an error."""
    found = _versions(spark, path)
    if not found:
        return empty(spark, schema)
    folder = f"{path}/version-{found[-1]:08d}"
    there = {f.name: f.dataType for f in spark.read.parquet(folder).schema}
    if wrong := [f.name for f in schema if there.get(f.name) != f.dataType]:
        raise ValueError(f"the snapshot has no columns {', '.join(wrong)} of these types")
    rows = spark.read.parquet(folder)
    of = lambda half: rows.where(F.col("half") == half).select(*schema.fieldNames())
    return Snapshot(rows.where("half = 'mark'").first()["source"], of(ACTIVE), of(PARKED), of(WITHDRAWN).select("id"))
