"""Registered queries of pages, reports, devices and projects, on the same usage events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from metergrid.functions import expr
from metergrid.operators import aggregate, hub, pricing, report, store, view
from metergrid.plans.query import UsageQuery
from metergrid.queries import CLOCK, QueryFn, breakdown, frame_of, priced_events, prices, project_insights, project_labels, selected, sessions, weekly_90d
from metergrid.workload import LOCAL_DEVICE, usage_events, usage_store


def window_owner(spark, sf_dir):
    """The calls of a week, with copies from outside it, which may own them."""
    usage = usage_store(spark, sf_dir)
    kept = store.window_owners(usage, frame_of(usage, UsageQuery(range="7d")), LOCAL_DEVICE)
    return kept.select("id", "harness", expr.device().alias("device"), "ms", expr.token_total().alias("tokens"))


def hourly_by(dimension: str) -> QueryFn:
    return lambda spark, sf_dir: aggregate.hourly_by(*selected(spark, sf_dir, UsageQuery(range="today")), dimension)


def facet_pairs(spark, sf_dir):
    return aggregate.model_providers(aggregate.with_keys(pricing.priced(usage_events(spark, sf_dir), prices(spark))))


def session_sorted(key: str, number: int = 1) -> QueryFn:
    def run(spark, sf_dir):
        found = view.page(sessions(spark, sf_dir), view.session_order(key), number)
        return found.select("rank", "session_id", "device", "harness")

    return run


def devices_table(spark, sf_dir):
    """Devices from suppliers: named, some revoked, some without version."""
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.concat(F.lit("dev-"), k.cast("string")).alias("id"), F.concat(F.lit("Host "), (k % 4).cast("string")).alias("name"), F.when(k % 2 == 0, "linux").otherwise("darwin").alias("platform"), F.when(k % 3 == 0, "1.2.0").alias("collector_version"),
        (k * 1000).cast("long").alias("last_seen_ms"), F.when(k % 5 == 0, k).cast("long").alias("revoked_ms"), F.when(k % 2 == 1, F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).alias("pricing_updated_at"), F.lit(None).cast("string").alias("sources"),
    )


def device_counts(spark, sf_dir):
    found = hub.device_counts(devices_table(spark, sf_dir), aggregate.dimension_counts(usage_events(spark, sf_dir)))
    return found.select("id", "name", "event_count")


def hub_info(spark, sf_dir):
    return hub.hub_info(devices_table(spark, sf_dir))


def device_register(spark, sf_dir):
    """Every third device registers anew, and as many new ones."""
    old, k = devices_table(spark, sf_dir), F.substring("id", 5, 20).cast("long")
    new = old.where(k % 3 == 1).select("id", F.concat(F.lit("New "), "id").alias("name"), F.lit("windows").alias("platform"), F.when(k % 2 == 0, " 2.0 ").alias("collector_version"))
    return hub.registered(old, new.union(new.withColumn("id", F.concat("id", F.lit("-b"))))).select("id", "name", "platform", "collector_version", "revoked_ms")


def device_heartbeat(spark, sf_dir):
    old, k = devices_table(spark, sf_dir), F.substring("id", 5, 20).cast("long")
    beats = old.where(k % 2 == 0).select(
        "id", F.lit("bsd").alias("platform"), F.col("last_seen_ms"), F.explode(F.array(F.lit(5), F.lit(9))).alias("later"), F.when(k % 4 == 0, "[]").alias("sources"),
        F.when(k % 4 == 0, "2025-01-01").otherwise("").alias("pricing_updated_at"), F.lit(None).cast("string").alias("collector_version"),
    ).withColumn("at_ms", F.col("last_seen_ms") + F.col("later"))
    return hub.seen(old, beats).select("id", "name", "platform", "last_seen_ms", "sources", "pricing_updated_at", "collector_version")


def device_suffixes(spark, sf_dir):
    return view.device_suffixes(devices_table(spark, sf_dir).select("id", F.col("name").alias("label")))


def price_snapshots(spark, sf_dir):
    rows = priced_events(spark, sf_dir).withColumns({"repriced": F.col("harness") != "grok", "pricing_snapshot": F.when(F.col("event_id") % 3 == 0, "2023-12").when(F.col("event_id") % 3 == 1, "")})
    return hub.price_snapshots(rows, "policy")


def session_export(spark, sf_dir):
    return report.session_export(sessions(spark, sf_dir), devices_table(spark, sf_dir).where("id <> 'dev-3'"))


def report_lines(spark, sf_dir):
    rows = selected(spark, sf_dir, UsageQuery())[0]
    return report.report_lines(aggregate.breakdown(rows, "harness"), aggregate.breakdown(rows, "model"))


def custom_interval(spark, sf_dir):
    rows = report.custom_interval(priced_events(spark, sf_dir), CLOCK, days=10, until=datetime.fromisoformat("2024-01-20T00:00:00+00:00"))
    return rows.agg(*aggregate.totals())


def weekly_buckets(spark, sf_dir):
    return view.day_buckets(weekly_90d(spark, sf_dir), "2024-01-25")


def hour_buckets(spark, sf_dir):
    rows, frame = selected(spark, sf_dir, UsageQuery(range="today"))
    return view.hour_buckets(aggregate.hourly(rows, frame), frame.now).select("hour", "first_ms", "tokens", "partial")


def bucket_neighbours(spark, sf_dir):
    return view.neighbours(weekly_90d(spark, sf_dir), "first", "2024-01-15")


def session_rows(spark, sf_dir):
    rows = selected(spark, sf_dir, UsageQuery())[0]
    return view.session_rows(aggregate.sessions(rows), rows.select("model")).select("session_id", "device", "harness", "project", "cost_usd", "unpriced_tokens", "multi_model")


def label_overrides(spark, sf_dir):
    return view.label_overrides(project_labels(spark, sf_dir))


def project_search(query: str, sort: str) -> QueryFn:
    def run(spark, sf_dir):
        index = view.project_index(project_insights(spark, sf_dir), usage_events(spark, sf_dir).select(expr.project_key().alias("project_key")))
        return view.search_projects(index, query, sort).select("rank", "key", "label", F.round("score", 6).alias("score"), "tokens")

    return run


def model_labels(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    name = F.expr("CASE k % 6 WHEN 0 THEN concat('claude-opus-4-', k % 9) WHEN 1 THEN concat('claude-sonnet-', k % 9, '-high') WHEN 2 THEN concat('cursor-grok-', k % 9) WHEN 3 THEN 'cursor/unknown' WHEN 4 THEN 'claude-other-1' ELSE concat('gpt-', k % 9) END")
    return p.select("k", name.alias("model")).select("k", expr.model_label(F.col("model")).alias("label"))


def session_links(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    url = F.expr("""CASE k % 6 WHEN 0 THEN concat('https://t.example/app/env', k % 5, '/th:', k) WHEN 1 THEN concat('http://user:pw@t.example/e/th:', k) WHEN 2 THEN concat('https://t.example/e/other', k)
      WHEN 3 THEN concat('https://t.example/e/th:', k, '?q=1') WHEN 4 THEN 'ftp://t.example/e/x' END""")
    repo = F.expr("CASE k % 4 WHEN 0 THEN concat('github.com/o/r', k) WHEN 1 THEN concat('local:', k) WHEN 2 THEN 'host.example/' END")
    rows = c.select("k", F.concat(F.lit("th:"), F.col("k").cast("string")).alias("thread"), url.alias("url"), repo.alias("repo"), F.when(F.col("k") % 2 == 0, "cursor").otherwise("pi").alias("harness"), F.when(F.col("k") % 10 == 0, "a b").otherwise(F.concat(F.lit("s"), F.col("k").cast("string"))).alias("session"))
    name = expr.session_name(F.lit(" "), F.when(F.col("k") % 3 == 0, F.lit(" N ")), F.coalesce("repo", F.lit("/a/b/c")))
    return rows.select("k", expr.safe_web_url(F.col("url")).alias("web"), expr.native_thread_url(F.col("thread"), F.col("url"), "t3code").alias("native"), expr.repository_url(F.col("repo")).alias("repository"), expr.agent_url(F.col("harness"), F.col("session")).alias("agent"), name.alias("name"))


def axis_peaks(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), (F.floor("o_totalprice") % 100_000).cast("double").alias("v"))
    return o.select("k", F.round(expr.nice_peak(F.col("v")), 6).alias("peak"))


def collector_versions(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    build = F.when(F.col("k") % 3 == 0, F.concat(F.lit(" "), F.col("name"))).when(F.col("k") % 3 == 1, F.lit("a b"))
    return n.select("k", expr.collector_version(F.lit("0.4.1"), build).alias("version"))


def catalog_merge(spark, sf_dir):
    """Two catalogs of the parts' brands: what the second one has of a model stands alone."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("concat(p_brand, '/', p_size) AS model", "element_at(array('input_cost_per_token', 'output_cost_per_token', 'cache_read_input_token_cost'), CAST(p_partkey % 3 + 1 AS INT)) AS field", "p_retailprice", "p_partkey", "p_size")
    of = lambda rows: rows.groupBy("model", "field").agg(F.max("p_retailprice").alias("rate"))
    return pricing.merged_catalogs(of(parts), of(parts.where("p_size % 4 = 0 AND p_partkey % 2 = 0")), of(parts.where("p_size % 8 = 0 AND p_partkey % 5 = 0")))


def changed_since(spark, sf_dir):
    """What a client that has the totals of each model before a correction is sent."""
    rows = breakdown("model")(spark, sf_dir).select("name", "tokens", "rank")
    known = hub.since(rows, spark.createDataFrame([], "name string, digest string"), ["name"])
    later = rows.withColumn("tokens", F.when(F.col("rank") == 2, F.col("tokens") + 1).otherwise(F.col("tokens")))
    return hub.since(later, known.where("rank <> 3"), ["name"]).drop("digest")


def migration_pages(spark, sf_dir):
    """Stored rows as import pages: those of one price snapshot and day together, in bounded batches."""
    rows = usage_events(spark, sf_dir).select(F.when(F.col("event_id") % 3 == 0, "2023-12").otherwise("").alias("pricing_snapshot"), F.floor(F.col("ms") / 86_400_000).alias("day"), "ms", "id", "device_id", F.lit(1).alias("size"))
    found = view.batches(rows, ["pricing_snapshot", "day"], ["ms", "device_id", "id"], "size", most_rows=25)
    return found.groupBy("pricing_snapshot", "day", "batch").agg(F.count("*").alias("n"))


def queries() -> dict[str, QueryFn]:
    found: dict[str, QueryFn] = {f"hourly_by_{d}": hourly_by(d) for d in ("harness", "model")}
    found |= {f"sessions_by_{k}": session_sorted(k) for k in ("started", "project", "model", "device", "tokens")}
    found |= {"sessions_last_page": session_sorted("active", 10**6), "project_search": project_search("r1 org", "tokens"), "project_search_fuzzy": project_search("nme", "name"), "project_search_all": project_search("", "recent")}
    for f in (
        window_owner, facet_pairs, device_counts, hub_info, device_register, device_heartbeat, device_suffixes, price_snapshots, session_export, report_lines, custom_interval, weekly_buckets, hour_buckets, bucket_neighbours,
        session_rows, label_overrides, model_labels, session_links, axis_peaks, collector_versions, catalog_merge, changed_since, migration_pages,
    ):
        found[f.__name__] = f
    return found
