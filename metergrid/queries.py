"""The registered queries: operators applied to the usage events made from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metergrid import tables
from metergrid.functions import expr
from metergrid.operators import aggregate, dedupe, merge, pricing, store, view
from metergrid.plans.query import Timeframe, UsageQuery, device_filter, dimension_filter, project_filter, timeframe
from metergrid.streaming import outbox
from metergrid.workload import CATALOG, LOCAL_DEVICE, NOW, RULES, usage_events, usage_store

CLOCK = datetime.fromisoformat(NOW)
QueryFn = Callable[[SparkSession, str], DataFrame]


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, "model string, field string, rate double")


def prices(spark: SparkSession) -> pricing.Prices:
    return pricing.price_tables(catalog(spark), RULES)


def priced_events(spark: SparkSession, sf_dir: str, query: UsageQuery = UsageQuery()) -> DataFrame:
    """All history: device filter, one row a call, price, keys."""
    events = usage_store(spark, sf_dir).rows().drop("utc_day").where(device_filter(query))
    return aggregate.with_keys(pricing.priced(dedupe.owner_dedup(events, LOCAL_DEVICE), prices(spark)))


def priced_window(spark: SparkSession, usage: store.Store, query: UsageQuery, frame: Timeframe) -> DataFrame:
    """What every dashboard query starts from: the calls of the window, by their owners, priced, with keys. Reads the
    partitions of the window's days, and of other days those with copies of its calls."""
    rows = store.window_owners(usage, frame, LOCAL_DEVICE, device_filter(query))
    return aggregate.with_keys(pricing.priced(rows, prices(spark)))


def frame_of(usage: store.Store, query: UsageQuery) -> Timeframe:
    earliest = store.earliest(usage, device_filter(query)) if query.range == "all" else None
    return timeframe(query, CLOCK, earliest)


def selected_from(usage: store.Store, query: UsageQuery) -> tuple[DataFrame, Timeframe]:
    query, _ = query.normalized()
    if query.models:
        query = replace(query, models=pricing.shown_models(usage.spark, query.models, catalog(usage.spark), RULES))
    frame = frame_of(usage, query)
    return priced_window(usage.spark, usage, query, frame).where(dimension_filter(query) & project_filter(query)), frame


def selected(spark: SparkSession, sf_dir: str, query: UsageQuery) -> tuple[DataFrame, Timeframe]:
    return selected_from(usage_store(spark, sf_dir), query)


def totals(query: UsageQuery) -> QueryFn:
    return lambda spark, sf_dir: selected(spark, sf_dir, query)[0].agg(*aggregate.totals())


def previous_totals(query: UsageQuery) -> QueryFn:
    def run(spark, sf_dir):
        usage = usage_store(spark, sf_dir)
        frame = frame_of(usage, query)
        if frame.previous is None:
            return priced_window(spark, usage, query, frame).limit(0).agg(*aggregate.totals())
        earlier = replace(frame, start=frame.previous, end=frame.start)
        return priced_window(spark, usage, query, earlier).where(dimension_filter(query) & project_filter(query)).agg(*aggregate.totals())

    return run


def breakdown(dimension: str, query: UsageQuery = UsageQuery()) -> QueryFn:
    return lambda spark, sf_dir: aggregate.breakdown(selected(spark, sf_dir, query)[0], dimension)


def daily(dimension: str) -> QueryFn:
    return lambda spark, sf_dir: aggregate.daily(*selected(spark, sf_dir, UsageQuery()), dimension)


def daily_zero_filled(query: UsageQuery) -> QueryFn:
    return lambda spark, sf_dir: aggregate.daily_totals(*selected(spark, sf_dir, query))


def hourly(zone: str) -> QueryFn:
    return lambda spark, sf_dir: aggregate.hourly(*selected(spark, sf_dir, UsageQuery(range="today", timezone=zone)))


def weekly_90d(spark, sf_dir):
    return aggregate.weekly(aggregate.daily_totals(*selected(spark, sf_dir, UsageQuery(range="90d"))))


def marginals(spark, sf_dir):
    return aggregate.marginals(selected(spark, sf_dir, UsageQuery())[0])


def owner_dedup(query: UsageQuery) -> QueryFn:
    def run(spark, sf_dir):
        kept = dedupe.owner_dedup(usage_events(spark, sf_dir).where(device_filter(query)), LOCAL_DEVICE)
        return kept.select("id", "harness", expr.device().alias("device"), "ms", expr.token_total().alias("tokens"))

    return run


def cross_window_owner(spark, sf_dir):
    return dedupe.divergent_copies(usage_events(spark, sf_dir))


def sessions(spark, sf_dir):
    return aggregate.sessions(selected(spark, sf_dir, UsageQuery())[0])


def sessions_page(key: str, number: int) -> QueryFn:
    def run(spark, sf_dir):
        found = view.page(sessions(spark, sf_dir), view.session_order(key), number)
        return found.select("rank", "session_id", "device", "harness", "tokens", "cost_usd", "last_active_ms")

    return run


def project_insights(spark, sf_dir):
    return aggregate.insights(selected(spark, sf_dir, UsageQuery())[0])


def facets(devices: tuple[str, ...] | None) -> QueryFn:
    def run(spark, sf_dir):
        events = usage_events(spark, sf_dir)
        return aggregate.facets(aggregate.with_keys(pricing.priced(events, prices(spark))), devices)

    return run


def dimension_counts(spark, sf_dir):
    return aggregate.dimension_counts(usage_events(spark, sf_dir))


def model_resolution(spark, sf_dir):
    found = pricing.resolve_models(usage_events(spark, sf_dir), catalog(spark), RULES)
    return found.select("raw_model", "model", "kind", "ruled", F.coalesce(F.size("rates"), F.lit(0)).alias("n_rates"))


def reprice(spark, sf_dir):
    rows = priced_events(spark, sf_dir)
    return rows.select("harness", "id", "model", F.round("cost_usd", 9).alias("cost_usd"), "cost_known", "gaps", *[F.round(f"parts.{p}", 9).alias(f"{p}_usd") for p in ("input", "output", "read", "write")])


def cost_parts(spark, sf_dir):
    return aggregate.attribution(selected(spark, sf_dir, UsageQuery())[0])


def unresolved_pricing(spark, sf_dir):
    return aggregate.unresolved(selected(spark, sf_dir, UsageQuery())[0])


def top10_union(spark, sf_dir):
    groups = breakdown("project")(spark, sf_dir).select("name", "tokens", "cost_usd")
    return view.top_rows(groups, 5)


def series_arrays(spark, sf_dir):
    rows, frame = selected(spark, sf_dir, UsageQuery())
    found = view.aligned(aggregate.daily(rows, frame, "model"), aggregate.day_calendar(rows, frame), "day")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return found.select("name", text("t").alias("t"), F.size("c").alias("n_c"), F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x), 4).alias("c_sum"), text("u").alias("u"))


def bucket_other(spark, sf_dir):
    return view.with_tails(aggregate.daily(*selected(spark, sf_dir, UsageQuery()), "project"), "day", 4)


def share_of_total(spark, sf_dir):
    groups = view.shares(breakdown("model")(spark, sf_dir).select("name", "tokens"))
    return groups.select("*", expr.share_text(F.col("tokens"), F.sum("tokens").over(Window.partitionBy())).alias("share_text"))


def period_delta(spark, sf_dir):
    """Each model's tokens against the period before, from one pass over both periods."""
    query = UsageQuery(range="7d")
    usage = usage_store(spark, sf_dir)
    frame = frame_of(usage, query)
    rows = priced_window(spark, usage, query, replace(frame, start=frame.previous))
    both = rows.groupBy(F.col("model").alias("name")).agg(
        F.coalesce(F.sum(F.when(F.col("ms") >= frame.start, F.col("tokens"))), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(F.col("ms") < frame.start, F.col("tokens"))), F.lit(0)).alias("previous")
    )
    size, direction = expr.period_delta(F.col("tokens"), F.col("previous"))
    return both.select("*", size.alias("delta"), direction.alias("direction"))


def counter_delta_reset(spark, sf_dir):
    """Running counters of lineitem with a reset every fourth line, back to the counts of single lines."""
    from metergrid.sources.logs import counter_deltas

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    part = Window.partitionBy("l_orderkey", F.floor((F.col("l_linenumber") - 1) / 4)).orderBy("l_linenumber")
    counted = lines.select("l_orderkey", "l_linenumber", F.sum("q").over(part).alias("input"), F.sum(F.col("q") * 2).over(part).alias("output"), F.sum(F.col("q") * 3).over(part).alias("total"))
    return counter_deltas(counted, ["l_orderkey"], ["l_linenumber"], ["input", "output", "total"])


def carry_forward_model(spark, sf_dir):
    from metergrid.sources.logs import carried

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("m"), F.col("turn").cast("string"))).alias("model"))
    return turns.select("conv_id", "turn", "role", carried("model", ["conv_id"], ["turn", "role"]).alias("model"))


def _files(spark, sf_dir):
    """Sessions in chains: each customer's session forks from the one with a seventh of its key."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    key = F.col("c_custkey")
    return c.select(
        key.cast("string").alias("session_id"), F.when(key >= 7, F.floor(key / 7).cast("string")).alias("parent_id"), F.when(key % 5 == 0, F.concat(F.lit("/p/"), F.col("c_nationkey").cast("string"))).alias("project"),
        (key * 10).cast("long").alias("forked_ms"),
    )


def parent_project_inherit(spark, sf_dir):
    return dedupe.inherited_project(_files(spark, sf_dir), 16)


def fork_owner(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select(F.col("o_custkey").cast("string").alias("session_id"), (F.col("o_orderkey") % 3).cast("string").alias("native_id"), (F.col("o_orderkey") % 5000).cast("long").alias("ms"))
    found = dedupe.fork_owner(rows, _files(spark, sf_dir), 16)
    return found.groupBy("session_id", "native_id", "owner").agg(F.count("*").alias("n"))


def claude_sidechain_filter(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    rows = l.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.when(F.col("l_linenumber") % 5 != 4, F.col("l_orderkey").cast("string")).alias("native_id"),
        F.lit("s").alias("session_id"), (F.col("l_linenumber") % 3 != 1).alias("sidechain"), F.lit(None).cast("string").alias("parent_id"),
        (F.col("l_quantity").cast("long") % 4).alias("input_tokens"), *[F.lit(0).cast("long").alias(c) for c in ("output_tokens", "cache_read_tokens", "cache_write_tokens")],
    )
    return dedupe.without_replays(rows).select("id", "sidechain", "input_tokens")


def incoming(events: DataFrame) -> DataFrame:
    """An upload: every ninth event, some with other tokens, some without metadata, some new."""
    e = F.col("event_id")
    batch = events.where((e % 9 == 0) & (F.col("device_id") != "dev-copy")).withColumns({
        "input_tokens": F.col("input_tokens") + F.when(e % 18 == 0, 100).otherwise(0),
        "session_title": F.when(e % 27 != 0, F.col("session_title")),
        "service_tier": F.when(e % 27 != 0, F.col("service_tier")),
        "repository": F.when(e % 4 != 0, F.col("repository")),
        "id": F.when(e % 45 == 0, F.concat(F.lit("n:"), e.cast("string"))).otherwise(F.col("id")),
    })
    return batch


def merge_preserve_metadata(spark, sf_dir):
    events = usage_events(spark, sf_dir)
    return merge.merged(events, incoming(events)).select("device_id", "id", "action", "old_ms", "input_tokens", "session_title", "service_tier", "repository", "cost_usd")


def changed_records(spark, sf_dir):
    events = usage_events(spark, sf_dir).where("device_id <> 'dev-copy'")
    checkpoint = events.select("id", merge.digest().alias("digest"))
    return merge.changed(incoming(events), checkpoint).select("id", "device_id", "input_tokens", "session_title")


def _after_merge(spark: SparkSession, sf_dir: str) -> store.Store:
    """A store of its own, after an upload that corrects, moves and adds rows and withdraws others."""
    events = usage_events(spark, sf_dir)
    usage = store.create(spark, tables.lasting(spark).folder_of("merged"), events, buckets=16)
    gone = events.where("event_id % 40 = 0").select("device_id", "id")
    store.merge(usage, incoming(events), "upload-1", gone)
    return usage


def stored_totals_after_merge(spark, sf_dir):
    rows, _ = selected_from(_after_merge(spark, sf_dir), UsageQuery())
    return aggregate.breakdown(rows, "harness")


def stored_dimension_counts(spark, sf_dir):
    """From the deltas of the merge, without a count of the rows."""
    return store.dimension_counts(_after_merge(spark, sf_dir))


def withdrawal_states(spark, sf_dir):
    """Withdrawn ids after a flush, an upload that brings some back, and a second withdrawal of a part of those."""
    events = usage_events(spark, sf_dir).where("device_id <> 'dev-copy'")
    folder = tables.lasting(spark).folder_of("withdrawals")
    hub, box = store.create(spark, f"{folder}/hub", events, buckets=16), outbox.Outbox(spark, f"{folder}/outbox")
    of = lambda n: events.where(F.col("event_id") % n == 0)
    outbox.withdraw(box, of(10))
    outbox.flush(box, lambda ids, number: store.merge(hub, events.limit(0), number, ids), together=True)
    store.merge(hub, of(20), "again")
    outbox.restore(box, of(20))
    outbox.withdraw(box, of(40))
    there = hub.rows().select("device_id", "id", F.lit(True).alias("stored"))
    return box.states().join(there, ["device_id", "id"], "left").select("device_id", "id", "state", F.coalesce("stored", F.lit(False)).alias("stored"))


def retractions(spark, sf_dir):
    events = usage_events(spark, sf_dir)
    gone = events.where("event_id % 40 = 0").select("id")
    return dedupe.retracted(gone, events.where("device_id = 'dev-copy' AND event_id % 3 = 0").select("id").distinct())


def import_missing(spark, sf_dir):
    events = usage_events(spark, sf_dir)
    return merge.only_missing(events, incoming(events)).select("device_id", "id", "input_tokens")


def batch_assign(spark, sf_dir):
    """Upload batches of each device and day."""
    events = usage_events(spark, sf_dir).select("device_id", F.floor(F.col("ms") / 86_400_000).alias("day"), "ms", "id", (F.char_length("id") + F.lit(300)).alias("size"))
    found = view.batches(events, ["device_id", "day"], ["ms", "id"], "size", most_rows=20, most_bytes=5_000)
    return found.groupBy("device_id", "day", "batch").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def billing_residual(spark, sf_dir):
    from metergrid.sources.billing import residual

    agents = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("agent"), (F.col("o_orderkey") % 97 + 150).cast("long").alias("tokens"))
    runs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("agent"), F.col("l_quantity").cast("long").alias("tokens"))
    return residual(agents, runs)


def project_labels(spark, sf_dir):
    events = usage_events(spark, sf_dir)
    return view.project_labels(events.select(F.coalesce(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/home/u"), F.col("project"))), F.col("repository"), F.col("project")).alias("project_key")))


def canonical_repository(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    text = F.expr("""CASE k % 6 WHEN 0 THEN concat('git@GitHub.com:Org/Repo', k, '.git') WHEN 1 THEN concat('https://user:pw@gitlab.com/A/B', k) WHEN 2 THEN concat('ssh://git@host.example:22/Team/R', k, '.git')
      WHEN 3 THEN concat('https://Code.Example/x/Y', k, '.git?q=1') WHEN 4 THEN concat('/local/path', k) ELSE '' END""")
    return c.select("k", text.alias("remote")).select("k", expr.canonical_repository(F.col("remote")).alias("repository"))


def catalog_search(spark, sf_dir):
    return view.catalog_search(catalog(spark), "g")


def csv_export_escape(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.expr("CASE c_custkey % 4 WHEN 0 THEN concat('=', c_name) WHEN 1 THEN concat(' -', c_name) WHEN 2 THEN concat('a\"', c_name) END").alias("v"))
    return c.select("k", expr.csv_cell(F.col("v")).alias("cell"))


ALL = UsageQuery(range="all")
FILTERS = {
    "filter_include": UsageQuery(projects=("github.com/org/r1", "/work/p12")),
    "filter_project_exclude_wins": UsageQuery(projects=("github.com/org/r1", "github.com/org/r2"), excluded_projects=("github.com/org/r1",)),
    "filter_empty_list": UsageQuery(models=()),
    "filter_multi_dimension": UsageQuery(harnesses=("claude", "codex"), devices=("dev-1", "dev-copy")),
    "filter_raw_models": UsageQuery(models=("xai/grok-4.6", "house-custom", "claude-fable-5-1-20260101", "quasar-alpha", "no such model")),
    "filter_provider": UsageQuery(providers=("openai", "google")),
}


def queries() -> dict[str, QueryFn]:
    found: dict[str, QueryFn] = {f"totals_{r}": totals(UsageQuery(range=r)) for r in ("today", "7d", "30d", "90d", "6m", "all")}
    found["totals_7d_kathmandu"] = totals(UsageQuery(range="7d", timezone="Asia/Kathmandu"))
    found["totals_previous_7d"] = previous_totals(UsageQuery(range="7d"))
    found |= {f"by_{d}": breakdown(d) for d in aggregate.DIMENSIONS}
    found |= {f"daily_by_{d}": daily(d) for d in aggregate.DIMENSIONS}
    found["daily_zero_filled"] = daily_zero_filled(UsageQuery())
    found["daily_zero_filled_new_york"] = daily_zero_filled(UsageQuery(timezone="America/New_York"))
    found |= {"hourly_today_utc": hourly("UTC"), "hourly_today_kathmandu": hourly("Asia/Kathmandu")}
    found |= {n: totals(q) for n, q in FILTERS.items()}
    found |= {"owner_dedup": owner_dedup(UsageQuery()), "owner_dedup_device_filter": owner_dedup(UsageQuery(devices=("dev-1", "dev-copy")))}
    found |= {"sessions_page2": sessions_page("active", 2), "sessions_by_cost": sessions_page("cost", 1), "facets": facets(None), "facets_of_device": facets(("dev-1",))}
    for f in (
        marginals, weekly_90d, cross_window_owner, sessions, project_insights, dimension_counts, model_resolution, reprice, cost_parts, unresolved_pricing, top10_union, series_arrays, bucket_other, share_of_total,
        period_delta, counter_delta_reset, carry_forward_model, parent_project_inherit, fork_owner, claude_sidechain_filter, merge_preserve_metadata, changed_records, stored_totals_after_merge, stored_dimension_counts, withdrawal_states, retractions, import_missing, batch_assign,
        billing_residual, project_labels, canonical_repository, catalog_search, csv_export_escape,
    ):
        found[f.__name__] = f
    return found
