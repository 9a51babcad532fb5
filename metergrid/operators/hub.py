"""Devices of a hub, what their rows hold, and whether something changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metergrid.operators.merge import digest

DEVICE = "id string, name string, platform string, collector_version string, last_seen_ms long, revoked_ms long, pricing_updated_at string, sources string"


def device_counts(devices: DataFrame, counts: DataFrame) -> DataFrame:
    """Devices with the number of their stored rows; counts (device, records) as dimension_counts() makes them."""
    held = counts.groupBy(F.col("device").alias("id")).agg(F.sum("records").alias("event_count"))
    return devices.join(held, "id", "left").withColumn("event_count", F.coalesce("event_count", F.lit(0)))


def registered(devices: DataFrame, new: DataFrame) -> DataFrame:
    """Devices after registrations (id, name, platform, collector_version). A revoked device stays as it is; a version that
    isn't told is kept."""
    n = new.select("id", F.col("name").alias("_name"), F.col("platform").alias("_platform"), F.nullif(F.trim("collector_version"), F.lit("")).alias("_version"), F.lit(True).alias("_new"))
    both = devices.withColumn("_there", F.lit(True)).join(n, "id", "full")
    take = F.col("_new").isNotNull() & F.col("revoked_ms").isNull()
    changed = {"name": F.when(take, F.col("_name")).otherwise(F.col("name")), "platform": F.when(take, F.col("_platform")).otherwise(F.col("platform")), "collector_version": F.when(take, F.coalesce("_version", "collector_version")).otherwise(F.col("collector_version"))}
    return both.withColumns(changed).select(*devices.columns)


def seen(devices: DataFrame, beats: DataFrame) -> DataFrame:
    """Devices after uploads (id, platform, at_ms, sources, pricing_updated_at, collector_version): what an upload leaves
    out is kept, and so is the name, which may have been changed here."""
    latest = beats.groupBy("id").agg(F.max_by(F.struct("platform", "at_ms", "sources", "pricing_updated_at", "collector_version"), "at_ms").alias("b"))
    both = devices.join(latest, "id", "left")
    text = lambda c: F.nullif(F.trim(f"b.{c}"), F.lit(""))
    changed = {"platform": F.coalesce("b.platform", "platform"), "last_seen_ms": F.coalesce("b.at_ms", "last_seen_ms"), "sources": F.coalesce("b.sources", "sources"), "pricing_updated_at": F.coalesce(text("pricing_updated_at"), "pricing_updated_at"), "collector_version": F.coalesce(text("collector_version"), "collector_version")}
    return both.withColumns(changed).select(*devices.columns)


def renamed(devices: DataFrame, device_id: str, name: str) -> DataFrame:
    return devices.withColumn("name", F.when(F.col("id") == device_id, F.lit(name)).otherwise(F.col("name")))


def revoked(devices: DataFrame, device_id: str, at_ms: int | None) -> DataFrame:
    """With the device revoked at a time, or restored (None)."""
    return devices.withColumn("revoked_ms", F.when(F.col("id") == device_id, F.lit(at_ms).cast("long")).otherwise(F.col("revoked_ms")))


def hub_info(devices: DataFrame) -> DataFrame:
    return devices.agg(F.count("*").alias("devices"), F.count_if(F.col("revoked_ms").isNull()).alias("active"), F.max(F.nullif("pricing_updated_at", F.lit(""))).alias("pricing_updated_at"))


def price_snapshots(rows: DataFrame, policy: str) -> DataFrame:
    """(snapshot, records) of the prices that rows with a known cost were made with: the policy, where it made them, else
    what the row's upload named, else 'unknown'. More than one is a mixture to warn of."""
    made = F.when(F.col("repriced"), F.lit(policy)).otherwise(F.coalesce(F.nullif("pricing_snapshot", F.lit("")), F.lit("unknown")))
    return rows.where("cost_known").groupBy(made.alias("snapshot")).agg(F.count("*").alias("records"))


def fingerprint(events: DataFrame) -> DataFrame:
    """One row that changes if any event does, whatever the order: the number of rows and two sums over their digests."""
    part = lambda n: F.sum(F.conv(F.substring(digest(), n, 15), 16, 10).cast("decimal(38,0)"))
    return events.agg(F.count("*").alias("records"), F.sha2(F.concat_ws("/", part(1).cast("string"), part(16).cast("string"), F.count("*").cast("string")), 256).alias("fingerprint"))


def since(rows: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a page that aren't as the client has them: known (key, digest) of what it was sent."""
    columns = [c for c in rows.columns if c not in key]
    now = rows.withColumn("digest", F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))
    return now.join(known.select(*key, F.col("digest").alias("_known")), key, "left").where(~F.col("digest").eqNullSafe(F.col("_known"))).drop("_known")
