"""The write path: an upload is merged into the stored rows by (device, id); retractions remove rows.

Stored rows lie in Parquet under utc_day=..., and write_days() rewrites the days that it touches: those of the new rows, and
those from which corrected rows moved away. It joins the upload with the keys of all stored rows; operators/store.py keeps
an index, by which a merge reads the days of its keys only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ["device_id", "id"]
#: Fields that a new row keeps where it leaves them out; all others are the new row's.
OPTIONAL = ("session_title", "project_name")
#: Rows of a file of the store.
FILE_ROWS = 1_000_000
#: Rows of an upload with its withdrawn ids.
MOST_ROWS = 10_000
CONTENT = (
    "ts", "ms", "harness", "raw_model", "project", "repository", "session_id", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "cost_usd", "cost_known",
    "reported_cost_usd", "service_tier", "cache_write_1h_tokens", "requests", "session_title", "project_name", "thread_id", "thread_url",
)


def violations() -> Column:
    """True for a row that no upload may hold: it needs an id and a time, and amounts that are finite and not negative."""
    bad = (F.coalesce(F.col("id"), F.lit("")) == "") | F.col("ts").isNull() | F.coalesce(F.col("requests") < 0, F.lit(False))
    for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens"):
        bad = bad | F.coalesce(F.col(c) < 0, F.lit(True))
    wrong = lambda c: F.isnan(c) | (F.col(c) < 0) | (F.col(c) == float("inf"))
    return bad | F.coalesce(wrong("cost_usd"), F.lit(True)) | F.coalesce(wrong("reported_cost_usd"), F.lit(False))


def checked(batch: DataFrame, deleted: DataFrame | None = None, most: int | None = MOST_ROWS) -> DataFrame:
    """The batch, or an error: it is taken whole or not at all. `most` bounds one upload; None is for bulk loads."""
    n, wrong = batch.agg(F.count("*"), F.count_if(violations())).first()
    if wrong:
        raise ValueError(f"the batch holds {wrong} invalid rows")
    if most is not None and n + (deleted.count() if deleted is not None else 0) > most:
        raise ValueError(f"the batch holds more than {most} rows")
    return batch


def digest(columns: tuple[str, ...] = CONTENT) -> Column:
    """A fingerprint of a row's content, in which null differs from ''."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def latest(batch: DataFrame, order: str = "seq") -> DataFrame:
    """Of several rows with one key, the last."""
    return batch.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def merged(stored: DataFrame, batch: DataFrame, snapshot: str = "") -> DataFrame:
    """One row for each key of the batch as it is to be stored, with `action` (insert, update or skip) and old_ms.

    Titles and project names that the new row leaves out are kept. A thread's id and url are kept together, where the new
    row has neither or the same id. A known remote repository of a row with a thread isn't lost to a local fallback of
    the same call without one. A cost that isn't known is 0. `snapshot` names the prices that the batch was made with: a
    row with the same content but other prices is an update, where the store has a column pricing_snapshot."""
    priced = "pricing_snapshot" in stored.columns
    content = (*CONTENT, "pricing_snapshot") if priced else CONTENT
    batch = batch.withColumn("pricing_snapshot", F.lit(snapshot)) if priced else batch
    old = stored.select(*[F.col(c).alias(c if c in KEY else f"o_{c}") for c in dict.fromkeys((*KEY, *content))], F.lit(True).alias("there"))
    both = batch.join(old, KEY, "left")
    col = F.col
    kept = {c: F.coalesce(col(c), col(f"o_{c}")) for c in OPTIONAL}
    for mine, other in (("thread_id", "thread_url"), ("thread_url", "thread_id")):
        kept[mine] = F.coalesce(col(mine), F.when(col(other).isNull() | (col(other) == col(f"o_{other}")), col(f"o_{mine}")))
    text = lambda c: F.coalesce(c, F.lit("")) != ""
    local = ~text(col("repository")) | col("repository").startswith("local:")
    remote = text(col("o_thread_id")) & text(col("o_repository")) & ~col("o_repository").startswith("local:")
    same = (col("harness") == col("o_harness")) & col("session_id").eqNullSafe(col("o_session_id")) & col("project").eqNullSafe(col("o_project"))
    kept["repository"] = F.when(local & remote & same & col("thread_id").isNull() & col("thread_url").isNull(), col("o_repository")).otherwise(col("repository"))
    kept["cost_usd"] = F.when(col("cost_known"), col("cost_usd")).otherwise(0.0)
    out = both.withColumns(kept)
    was = F.sha2(F.to_json(F.struct(*[F.col(f"o_{c}").alias(c) for c in content]), {"ignoreNullFields": "false"}), 256)
    action = F.when(col("there").isNull(), "insert").when(digest(content) == was, "skip").otherwise("update")
    return out.withColumn("action", action).withColumn("old_ms", col("o_ms")).drop("there", *[f"o_{c}" for c in content])


def only_missing(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """An import: rows whose key isn't stored."""
    return batch.join(stored.select(*KEY), KEY, "left_anti")


def after(stored: DataFrame, batch: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """All stored rows after the merge and the retraction of `deleted` (device_id, id)."""
    new = merged(stored, batch).select(*stored.columns)
    rest = stored.join(batch.select(*KEY), KEY, "left_anti")
    out = rest.unionByName(new)
    return out.join(deleted.select(*KEY), KEY, "left_anti") if deleted is not None else out


def changed(rows: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Rows whose digest isn't the one recorded in checkpoint (id, digest): the new and the corrected ones."""
    now = rows.withColumn("digest", digest())
    known = checkpoint.select("id", F.col("digest").alias("known"))
    return now.join(known, "id", "left").where(~F.col("digest").eqNullSafe(F.col("known"))).drop("known")


def utc_day() -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ms") / 86_400_000).cast("int"))


def occupied_days(events: DataFrame) -> DataFrame:
    """(utc_day): days that hold rows."""
    return events.select(utc_day().alias("utc_day")).distinct()


def read_store(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_days(spark: SparkSession, path: str, batch: DataFrame, schema, scratch: str, deleted: DataFrame | None = None) -> dict[str, int]:
    """Merges batch into the store at `path` and returns counts of actions. Only the touched days are rewritten, by
    dynamic partition overwrite, from a table written beside the store, so a failed run can be repeated."""
    stored = read_store(spark, path, schema)
    columns = [c for c in stored.columns if c != "utc_day"]
    batch.write.mode("overwrite").parquet(f"{scratch}/batch")
    batch = spark.read.schema(batch.schema).parquet(f"{scratch}/batch")
    moves = merged(stored, batch)
    moves.write.mode("overwrite").parquet(f"{scratch}/moves")
    moves = spark.read.schema(moves.schema).parquet(f"{scratch}/moves")
    counts = {r["action"]: r["n"] for r in moves.groupBy("action").agg(F.count("*").alias("n")).collect()}
    live = moves.where("action <> 'skip'")
    days = live.select(utc_day().alias("utc_day")).union(live.where("old_ms IS NOT NULL").withColumn("ms", F.col("old_ms")).select(utc_day()))
    gone = live.select(*KEY)
    if deleted is not None:
        withdrawn = stored.join(deleted.select(*KEY), KEY, "left_semi")
        counts["delete"] = withdrawn.count()
        days, gone = days.union(withdrawn.select("utc_day")), gone.union(deleted.select(*KEY))
    touched = [r[0] for r in days.distinct().collect()]  # days, a partition each
    if touched:
        rest = stored.where(F.col("utc_day").isin(*touched)).join(gone, KEY, "left_anti").select(*columns)
        new = live if deleted is None else live.join(deleted.select(*KEY), KEY, "left_anti")
        result = rest.unionByName(new.select(*columns)).withColumn("utc_day", utc_day())
        result.write.mode("overwrite").parquet(f"{scratch}/result")
        whole = spark.read.schema(result.schema).parquet(f"{scratch}/result")
        # about FILE_ROWS rows a task and file: a day with many rows isn't one task
        parts = max(1, -(-whole.count() // FILE_ROWS))
        whole.repartition(parts, "utc_day", F.pmod(F.xxhash64("id"), F.lit(parts))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("utc_day").parquet(path)
        # a day whose last row went has no partition in the result to overwrite it
        empty = set(touched) - {r[0] for r in whole.select("utc_day").distinct().collect()}
        for day in empty:
            spark.createDataFrame([], whole.drop("utc_day").schema).write.mode("overwrite").parquet(f"{path}/utc_day={day}")
    return counts
