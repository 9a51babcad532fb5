"""The stored table: rows by UTC day, an index from calls to their days, and aggregates that follow the merges.

    rows/utc_day=...     the rows, a key (device_id, id) each
    keys/bucket=...      (device_id, id, harness, utc_day) of every row, by a hash of the id
    spread/bucket=...    the part of the index whose calls (harness, id) have copies on several days
    deltas/batch=...     what each merge added to and took from the dimension counts and the fingerprint
    pending/...          a merge under way

A window is read from the partitions of its days. Copies of its calls outside, one of which may own a call, come from the
days that `spread` names and no others. A merge looks the keys of its batch up in the index, reads the days that they lie in
and rewrites the days and index buckets that change.

A merge writes first what it is going to do (moves, then whole new days, then whole new buckets), and then replaces
partitions; each step can be repeated. After a failure the same batch_id carries on with what was written, so counts and
fingerprint take each batch once."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metergrid.functions.expr import device, project_key
from metergrid.operators.dedupe import owner_dedup
from metergrid.operators.merge import FILE_ROWS, KEY, digest, merged, utc_day
from metergrid.plans.query import Timeframe, within

INDEX = T.StructType().add("device_id", T.StringType()).add("id", T.StringType()).add("harness", T.StringType()).add("utc_day", T.DateType()).add("bucket", T.IntegerType())
DIMENSIONS = ("device", "harness", "model", "project")
#: How each merge changed the number of rows of a tuple, and the sums of their digests.
SUMS = {"records": T.LongType(), "low": T.DecimalType(38, 0), "high": T.DecimalType(38, 0)}
DELTAS = T.StructType([*[T.StructField(c, T.StringType()) for c in DIMENSIONS], *[T.StructField(c, t) for c, t in SUMS.items()], T.StructField("batch", T.StringType())])


@dataclass(frozen=True)
class Store:
    """schema: of the rows, without utc_day. buckets: of the index, set once."""

    spark: SparkSession
    path: str
    schema: T.StructType
    buckets: int = 64

    def rows(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("utc_day", T.DateType())])).parquet(f"{self.path}/rows")

    def keys(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.path}/keys")

    def spread(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.path}/spread")

    def deltas(self) -> DataFrame:
        return self.spark.read.schema(DELTAS).parquet(f"{self.path}/deltas")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def _fs(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, *parts: str) -> bool:
        fs, path = self._fs(*parts)
        return fs.exists(path)

    def delete(self, *parts: str) -> None:
        fs, path = self._fs(*parts)
        fs.delete(path, True)

    def staged(self, df: DataFrame, *parts: str) -> DataFrame:
        """df written under pending, unless an earlier run of the merge has written it whole."""
        path = "/".join((self.path, "pending", *parts))
        if not self.exists("pending", *parts, "_SUCCESS"):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def _replace(store: Store, table: str, df: DataFrame, by: str, touched: list, parts: int = 1) -> None:
    """The partitions `touched` of a table become those of df; one without rows becomes empty."""
    dealt = df.repartition(parts, by, F.pmod(F.xxhash64("id"), F.lit(parts)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{store.path}/{table}")
    left = {r[0] for r in df.select(by).distinct().collect()}
    for value in touched:
        if value not in left:
            store.delete(table, f"{by}={value}")


def _index(rows: DataFrame, store: Store) -> DataFrame:
    return rows.select("device_id", "id", "harness", utc_day().alias("utc_day")).withColumn("bucket", store.bucket())


def _spread(index: DataFrame) -> DataFrame:
    # a window over the copies of a call: the index is shuffled once
    call = Window.partitionBy("harness", "id")
    days = index.withColumns({"low": F.min("utc_day").over(call), "high": F.max("utc_day").over(call)})
    return days.where("low < high").select(*INDEX.fieldNames())


def _summed(rows: DataFrame, sign: int) -> DataFrame:
    """Number of rows and two sums over their digests for each tuple of dimensions."""
    part = lambda n: F.sum(F.conv(F.substring(digest(), n, 15), 16, 10).cast("decimal(38,0)") * sign)
    keys = (device().alias("device"), "harness", F.col("raw_model").alias("model"), project_key().alias("project"))
    return rows.groupBy(*keys).agg((F.count("*") * sign).alias("records"), part(1).cast("decimal(38,0)").alias("low"), part(16).cast("decimal(38,0)").alias("high"))


def create(spark: SparkSession, path: str, events: DataFrame, buckets: int = 64) -> Store:
    """A new store of events, whose keys must be unique."""
    store = Store(spark, path, events.schema, buckets)
    rows = events.withColumn("utc_day", utc_day())
    rows.repartition("utc_day", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("utc_day").parquet(f"{path}/rows")
    _index(store.rows(), store).repartition("bucket", F.pmod(F.xxhash64("device_id", "id"), F.lit(8))).write.partitionBy("bucket").parquet(f"{path}/keys")
    _spread(store.keys()).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/spread")
    _summed(store.rows(), 1).withColumn("batch", F.lit("base")).write.partitionBy("batch").parquet(f"{path}/deltas")
    return store


def merge(store: Store, batch: DataFrame, batch_id: str, deleted: DataFrame | None = None, snapshot: str = "") -> dict[str, int]:
    """Merges batch, one row a key, and withdraws `deleted` (device_id, id), which wins over the batch. Returns the counts of
    inserts, updates, skips and deletes."""
    spark, columns = store.spark, store.schema.fieldNames()
    keys = batch.select(*KEY) if deleted is None else batch.select(*KEY).union(deleted.select(*KEY))
    asked = store.staged(keys.distinct().withColumn("bucket", store.bucket()), batch_id, "keys")
    buckets = [r[0] for r in asked.select("bucket").distinct().collect()]
    there = store.keys().where(F.col("bucket").isin(*buckets)).join(asked.select(*KEY), KEY, "left_semi")
    days = [r[0] for r in there.select("utc_day").distinct().collect()]
    stored = store.rows().where(F.col("utc_day").isin(*days)).join(asked.select(*KEY), KEY, "left_semi")

    new = merged(stored, batch, snapshot)
    if deleted is not None:
        gone = deleted.select(*KEY).distinct()
        new = new.join(gone, KEY, "left_anti")
        out = stored.join(gone, KEY, "left_semi").withColumn("old_ms", F.col("ms")).withColumn("action", F.lit("delete"))
        new = new.select(*columns, "old_ms", "action").unionByName(out.select(*columns, "old_ms", "action"))
    old = F.struct(*[F.col(c) for c in columns]).alias("old")
    new = new.select(*columns, "old_ms", "action").join(stored.select(*KEY, old), KEY, "left")
    moves = store.staged(new, batch_id, "moves")
    counts = {r["action"]: r["n"] for r in moves.groupBy("action").agg(F.count("*").alias("n")).collect()}
    live = moves.where("action <> 'skip'")
    kept = live.where("action <> 'delete'")
    before = live.where("old_ms IS NOT NULL").select("old.*")

    touched = [r[0] for r in kept.select(utc_day()).union(before.select(utc_day())).distinct().collect()]
    if touched:
        rest = store.rows().where(F.col("utc_day").isin(*touched)).join(live.select(*KEY), KEY, "left_anti")
        whole = store.staged(rest.unionByName(kept.select(*columns).withColumn("utc_day", utc_day())), batch_id, "rows")
        _replace(store, "rows", whole, "utc_day", touched, max(1, -(-whole.count() // FILE_ROWS)))
        changed = [r[0] for r in live.select(store.bucket()).distinct().collect()]
        others = store.keys().where(F.col("bucket").isin(*changed)).join(live.select(*KEY), KEY, "left_anti")
        index = store.staged(others.unionByName(_index(kept, store)), batch_id, "index")
        _replace(store, "keys", index, "bucket", changed, max(1, -(-index.count() // FILE_ROWS)))
        _replace(store, "spread", store.staged(_spread(index), batch_id, "spread"), "bucket", changed)
        delta = _summed(kept.select(*columns), 1).unionByName(_summed(before, -1)).withColumn("batch", F.lit(batch_id))
        delta.repartition(1, "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{store.path}/deltas")
    store.delete("pending", batch_id)
    return counts


def compact(store: Store) -> None:
    """The deltas of all merges so far as one. Not while a merge runs."""
    whole = store.staged(_totals(store).withColumn("batch", F.lit("base")), "compaction", "deltas")
    whole.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("batch").parquet(f"{store.path}/deltas")
    store.delete("pending", "compaction")


def _totals(store: Store) -> DataFrame:
    return store.deltas().groupBy(*DIMENSIONS).agg(*[F.sum(c).cast(t).alias(c) for c, t in SUMS.items()]).where("records <> 0")


def dimension_counts(store: Store) -> DataFrame:
    """As aggregate.dimension_counts() of all rows, from the deltas alone."""
    return _totals(store).select(*DIMENSIONS, "records")


def fingerprint(store: Store) -> DataFrame:
    """As hub.fingerprint() of all rows, from the deltas alone."""
    n, low, high = (F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS)
    total = store.deltas().agg(n, low, high)
    text = lambda c: F.when(F.col("records") > 0, F.col(c).cast("string"))
    return total.select("records", F.sha2(F.concat_ws("/", text("low"), text("high"), F.col("records").cast("string")), 256).alias("fingerprint"))


def days_of(first_ms: int, last_ms: int) -> tuple[date, date]:
    """The UTC days of the first and last instant."""
    start = date(1970, 1, 1)
    return start + timedelta(days=first_ms // 86_400_000), start + timedelta(days=last_ms // 86_400_000)


def window(store: Store, first_ms: int, last_ms: int) -> DataFrame:
    """All rows of the days that the window touches, and the copies of their calls on other days."""
    first, last = days_of(first_ms, last_ms)
    inside = F.col("utc_day").between(first, last)
    spread = store.spread()
    far = spread.where(~inside).join(spread.where(inside).select("harness", "id").distinct(), ["harness", "id"], "left_semi")
    days = [r[0] for r in far.select("utc_day").distinct().collect()]
    rows = store.rows().where(inside)
    if days:
        rows = rows.unionByName(store.rows().where(F.col("utc_day").isin(*days)).join(far.select("harness", "id").distinct(), ["harness", "id"], "left_semi"))
    return rows.drop("utc_day")


def window_owners(store: Store, frame: Timeframe, local_device: str, devices: Column | None = None) -> DataFrame:
    """The calls inside the window, each by the copy that owns it: a copy outside takes its call out of the window."""
    rows = window(store, frame.start, min(frame.end, frame.now))
    return owner_dedup(rows if devices is None else rows.where(devices), local_device).where(within(frame))


def earliest(store: Store, devices: Column | None = None) -> int | None:
    """The first instant, from the first day that holds a row."""
    rows = store.rows() if devices is None else store.rows().where(devices)
    first = rows.agg(F.min("utc_day")).first()[0]
    return None if first is None else rows.where(F.col("utc_day") == first).agg(F.min("ms")).first()[0]
