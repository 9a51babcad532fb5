"""Registered queries equal their SQL; invariants between them."""

import glob
import os

import duckdb
import pytest

from metergrid import log_oracle, log_queries, oracle, page_oracle, page_queries
from metergrid import queries as core


def queries():
    return core.queries() | page_queries.queries() | log_queries.queries()


def oracle_sql():
    found = oracle.oracle_sql()
    return found | page_oracle.oracle_sql(found) | log_oracle.oracle_sql()


def _value(v):
    return round(v, 8) if isinstance(v, float) else v


def rows(df, columns):
    return sorted((tuple(_value(r[c]) for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


CHECKED = ("totals_7d_kathmandu", "by_model", "marginals", "daily_zero_filled_new_york", "hourly_today_kathmandu", "weekly_90d", "owner_dedup_device_filter", "sessions", "facets_of_device", "reprice", "cost_parts",
           "unresolved_pricing", "series_arrays", "bucket_other", "period_delta", "counter_delta_reset", "fork_owner", "parent_project_inherit", "merge_preserve_metadata", "changed_records", "project_labels", "canonical_repository", *page_queries.queries(), *log_queries.queries())


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf_dir, duck, name):
    found = queries()[name](spark, sf_dir)
    columns = sorted(found.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall()
    assert rows(found, columns) == sorted((tuple(_value(v) for v in r) for r in want), key=repr)


def test_windows_apply_after_copies_are_removed(spark, sf_dir):
    """A winner may lie outside the window, and then its call vanishes from it."""
    from metergrid.operators.dedupe import owner_dedup
    from metergrid.plans.query import UsageQuery, timeframe, within
    from metergrid.queries import CLOCK
    from metergrid.workload import LOCAL_DEVICE, usage_events

    frame, events = timeframe(UsageQuery(range="7d"), CLOCK), usage_events(spark, sf_dir)
    right, wrong = owner_dedup(events, LOCAL_DEVICE).where(within(frame)), owner_dedup(events.where(within(frame)), LOCAL_DEVICE)
    assert right.count() != wrong.count()
