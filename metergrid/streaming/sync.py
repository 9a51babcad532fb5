"""Incremental sync: upload files arrive as a stream and are merged by key.

There is no watermark: any row may be corrected or withdrawn at any time. A batch that is replayed after a failure
merges to the same store, so each upload takes effect once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from metergrid.operators.merge import checked, latest, write_days


def sync(spark: SparkSession, incoming: str, store: str, checkpoint: str, upload: StructType, stored: StructType, available_now: bool = True, every: str = "5 minutes"):
    """Starts a query that merges Parquet uploads below `incoming` into `store`. Uploads have the columns of the store
    and `change` (upsert or delete) and `seq`; of several rows with a key the one with the largest seq counts."""

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        rows = latest(batch)
        upserts = checked(rows.where("change = 'upsert'"), most=None).drop("change", "seq")
        write_days(batch.sparkSession, store, upserts, stored, f"{checkpoint}/batch-{batch_id}", rows.where("change = 'delete'").select("device_id", "id"))

    stream = spark.readStream.schema(upload).parquet(incoming)
    writer = stream.writeStream.foreachBatch(merge_batch).option("checkpointLocation", f"{checkpoint}/state")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def changes(rows: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """An upload: rows as upserts and (device_id, id) of deleted ones, in the order of seq."""
    out = rows.withColumns({"change": F.lit("upsert"), "seq": F.lit(1).cast("long")})
    if deleted is None:
        return out
    gone = deleted.select("device_id", "id").withColumns({"change": F.lit("delete"), "seq": F.lit(2).cast("long")})
    return out.unionByName(gone, allowMissingColumns=True)
