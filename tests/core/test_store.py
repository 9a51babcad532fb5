"""The stored table: pruned windows, merges that can be repeated, aggregates that follow them."""

import uuid

import pytest
from pyspark.sql import functions as F

from metergrid.operators import aggregate, dedupe, hub, merge, store
from metergrid.plans.query import UsageQuery, timeframe, within
from metergrid.queries import CLOCK, incoming
from metergrid.workload import LOCAL_DEVICE, usage_events


@pytest.fixture()
def made(spark, sf_dir, tmp_path):
    return store.create(spark, f"{tmp_path}/s-{uuid.uuid4().hex}", usage_events(spark, sf_dir), buckets=4)


def _upload(spark, sf_dir):
    events = usage_events(spark, sf_dir)
    moved = incoming(events).withColumn("ms", F.when(F.col("event_id") % 36 == 0, F.col("ms") + 3 * 86_400_000).otherwise(F.col("ms")))
    return moved, events.where("event_id % 40 = 0").select("device_id", "id")


def _same(a, b):
    columns = sorted(a.columns)
    return sorted(map(repr, a.select(columns).collect())) == sorted(map(repr, b.select(columns).collect()))


def _consistent(made, rows):
    """Rows, index and aggregates all say the same."""
    assert _same(made.rows().drop("utc_day"), rows)
    assert made.rows().where(F.col("utc_day") != merge.utc_day()).count() == 0
    want = rows.select("device_id", "id", "harness", merge.utc_day().alias("utc_day")).withColumn("bucket", made.bucket())
    assert _same(made.keys(), want)
    several = want.groupBy("harness", "id").agg(F.count_distinct("utc_day").alias("n")).where("n > 1")
    assert _same(made.spread(), want.join(several, ["harness", "id"], "left_semi").select(*want.columns))
    assert _same(store.dimension_counts(made), aggregate.dimension_counts(rows))
    assert _same(store.fingerprint(made), hub.fingerprint(rows))


def test_merges_keep_rows_index_and_aggregates(spark, sf_dir, made):
    batch, gone = _upload(spark, sf_dir)
    stored = usage_events(spark, sf_dir)
    _consistent(made, stored)
    counts = store.merge(made, batch, "a", gone)
    after = merge.after(stored, batch, gone).select(*stored.columns)
    _consistent(made, after)
    assert set(counts) == {"insert", "update", "skip", "delete"} and counts["delete"] == gone.count()
    # the same upload again changes nothing but the ids that it brings back
    again = store.merge(made, batch.join(gone, ["device_id", "id"], "left_anti"), "b")
    assert set(again) == {"skip"}
    store.compact(made)
    _consistent(made, after)
    # all rows of some days go
    first = made.rows().agg(F.min("utc_day")).first()[0]
    whole = made.rows().where(F.col("utc_day") == first).select("device_id", "id").collect()
    store.merge(made, batch.limit(0), "c", spark.createDataFrame(whole, "device_id string, id string"))
    assert not made.exists("rows", f"utc_day={first}")
    _consistent(made, after.where(merge.utc_day() != F.lit(first)))


@pytest.mark.parametrize("fails", ["moves", "rows", "index", "spread", "deltas"])
def test_a_failed_merge_carries_on(spark, sf_dir, made, monkeypatch, fails):
    batch, gone = _upload(spark, sf_dir)
    stored = usage_events(spark, sf_dir)
    class Lost(Exception):
        pass

    replace, staged = store._replace, store.Store.staged

    def failing_replace(of, table, *rest):
        replace(of, table, *rest)
        if (table, fails) in (("rows", "rows"), ("keys", "index"), ("spread", "deltas")):
            raise Lost

    def failing_staged(self, df, *parts):
        out = staged(self, df, *parts)
        if parts[-1] == fails == "moves" or parts[-1] == fails == "spread":
            raise Lost
        return out

    with monkeypatch.context() as m:
        m.setattr(store, "_replace", failing_replace)
        m.setattr(store.Store, "staged", failing_staged)
        with pytest.raises(Lost):
            store.merge(made, batch, "a", gone)
    store.merge(made, batch, "a", gone)
    _consistent(made, merge.after(stored, batch, gone).select(*stored.columns))
    assert not made.exists("pending", "a")


@pytest.mark.parametrize("range_", ["today", "7d", "30d"])
def test_windows_read_their_days_and_copies(spark, sf_dir, made, range_):
    frame = timeframe(UsageQuery(range=range_), CLOCK)
    want = dedupe.owner_dedup(usage_events(spark, sf_dir), LOCAL_DEVICE).where(within(frame))
    assert _same(store.window_owners(made, frame, LOCAL_DEVICE), want)


def test_partitions_are_pruned(spark, made):
    frame = timeframe(UsageQuery(range="today"), CLOCK)
    plan = store.window_owners(made, frame, LOCAL_DEVICE)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan" in x and "input_tokens" in x]
    assert scans and all("utc_day" in x.split("PartitionFilters: [")[1].split("]")[0] for x in scans)


def test_an_empty_store(spark, sf_dir, tmp_path):
    events = usage_events(spark, sf_dir)
    made = store.create(spark, f"{tmp_path}/empty", events.limit(0), buckets=2)
    assert store.earliest(made) is None and store.fingerprint(made).first()["records"] == 0
    store.merge(made, events.where("device_id <> 'dev-copy'"), "a")
    _consistent(made, events.where("device_id <> 'dev-copy'"))
