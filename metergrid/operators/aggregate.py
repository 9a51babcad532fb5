"""Totals, breakdowns, series, sessions, insights and facets of priced events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metergrid.functions.expr import device, project_key, provider, request_count, session_key, token_total
from metergrid.plans.query import Timeframe

DIMENSIONS = {"harness": "harness", "model": "model", "provider": "provider", "project": "project_key", "device": "device"}
SUMS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens")


def with_keys(priced: DataFrame) -> DataFrame:
    return priced.withColumns(
        {"tokens": token_total(), "project_key": project_key(), "device": device(), "session_key": session_key(), "request_count": request_count(), "provider": provider("model")}
    )


def _cost(x: Column) -> Column:
    """Costs leave rounded to nine decimals, above what the order of a sum can change."""
    return F.round(F.coalesce(x, F.lit(0.0)), 9)


def totals() -> list[Column]:
    """The measures of a group of rows; unpriced tokens are those of rows without a known cost."""
    read, prompt = F.sum("cache_read_tokens"), F.sum(F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens"))
    return [
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS],
        _cost(F.sum("cost_usd")).alias("cost_usd"),
        F.coalesce(F.sum(F.when(~F.col("cost_known"), F.col("tokens"))), F.lit(0)).alias("unpriced_tokens"),
        F.count_distinct("session_key").alias("sessions"),
        F.coalesce(F.sum(F.col("request_count").cast("long")), F.lit(0)).alias("requests"),
        F.round(F.when(prompt > 0, read / prompt).otherwise(0.0), 6).alias("cache_hit_rate"),
    ]


def measures() -> list[Column]:
    return [F.sum("tokens").alias("tokens"), _cost(F.sum("cost_usd")).alias("cost_usd"), F.coalesce(F.sum(F.when(~F.col("cost_known"), F.col("tokens"))), F.lit(0)).alias("unpriced_tokens")]


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Adds rank, from 1. The rows are groups of a breakdown, which is what a page shows, not events."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def breakdown(rows: DataFrame, dimension: str) -> DataFrame:
    """Totals by a dimension, most tokens first, then by name."""
    return ranked(rows.groupBy(F.col(DIMENSIONS[dimension]).alias("name")).agg(*totals()), F.desc("tokens"), F.asc("name"))


def marginals(rows: DataFrame) -> DataFrame:
    """All five breakdowns and the grand total in one pass."""
    columns = list(DIMENSIONS.values())
    sets = rows.groupingSets([[c] for c in columns] + [[]], *columns).agg(*totals(), F.grouping_id().alias("g"))
    bits = {(1 << len(columns)) - 1 - (1 << (len(columns) - 1 - i)): n for i, n in enumerate(DIMENSIONS)}
    name = F.coalesce(*[F.when(F.col("g") == g, F.lit(n)) for g, n in bits.items()], F.lit("total"))
    return sets.select(name.alias("dimension"), F.coalesce(*columns, F.lit("")).alias("name"), *[c for c in sets.columns if c not in (*columns, "g")])


def day_calendar(rows: DataFrame, frame: Timeframe) -> DataFrame:
    """(day, first_ms, next_ms) of every local day of the period."""
    return rows.sparkSession.createDataFrame(list(frame.days), "day date, first_ms long, next_ms long")


def with_day(rows: DataFrame, frame: Timeframe) -> DataFrame:
    local = F.convert_timezone(F.lit("UTC"), F.lit(frame.zone), F.col("ts"))
    return rows.withColumn("day", local.cast("date"))


def daily(rows: DataFrame, frame: Timeframe, dimension: str) -> DataFrame:
    """Cells by local day; those of harnesses with all totals."""
    cells = with_day(rows, frame).groupBy("day", F.col(DIMENSIONS[dimension]).alias("name"))
    return cells.agg(*(totals() if dimension == "harness" else measures()))


def daily_totals(rows: DataFrame, frame: Timeframe) -> DataFrame:
    """A row for every local day, also those without events."""
    found = with_day(rows, frame).groupBy("day").agg(*measures())
    zero = {"tokens": F.lit(0), "cost_usd": F.lit(0.0), "unpriced_tokens": F.lit(0)}
    return day_calendar(rows, frame).join(found, "day", "left").select("day", *[F.coalesce(c, z).alias(c) for c, z in zero.items()])


def _hour(rows: DataFrame, frame: Timeframe) -> DataFrame:
    """Elapsed hours of the local day: by instant, so that changed clocks and half-hour zones come right."""
    return rows.withColumn("hour", F.floor((F.col("ms") - frame.today) / 3_600_000).cast("int"))


def hourly(rows: DataFrame, frame: Timeframe) -> DataFrame:
    """A row for every hour of the local day."""
    hours = rows.sparkSession.createDataFrame(frame.hours, "hour int, first_ms long")
    found = _hour(rows, frame).groupBy("hour").agg(*measures())
    return hours.join(found, "hour", "left").select("hour", "first_ms", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"), F.coalesce("unpriced_tokens", F.lit(0)).alias("unpriced_tokens"))


def hourly_by(rows: DataFrame, frame: Timeframe, dimension: str) -> DataFrame:
    """Cells by hour of the local day; those of harnesses with all totals."""
    return _hour(rows, frame).groupBy("hour", F.col(DIMENSIONS[dimension]).alias("name")).agg(*(totals() if dimension == "harness" else measures()))


def weekly(days: DataFrame) -> DataFrame:
    """Days in Monday weeks; a week is named by its first day of the period, and `last` is null for a single day."""
    week = days.groupBy(F.date_trunc("week", "day").cast("date").alias("week"))
    grouped = week.agg(F.min("day").alias("first"), F.max("day").alias("end"), F.sum("tokens").alias("tokens"), _cost(F.sum("cost_usd")).alias("cost_usd"), F.sum("unpriced_tokens").alias("unpriced_tokens"))
    return grouped.select("first", F.when(F.col("end") > F.col("first"), F.col("end")).alias("last"), "tokens", "cost_usd", "unpriced_tokens")


def attribution(rows: DataFrame) -> DataFrame:
    """Cost by kind of token where rates explain it, the tokens where they don't, and known cost without parts."""
    out = []
    for name, tokens in (("input", "input_tokens"), ("output", "output_tokens"), ("read", "cache_read_tokens"), ("write", "cache_write_tokens")):
        out.append(_cost(F.sum(F.col(f"parts.{name}"))).alias(f"{name}_usd"))
        out.append(F.coalesce(F.sum(F.when(F.col("parts").isNull(), F.col(tokens))), F.lit(0)).alias(f"{name}_unavailable"))
    return rows.agg(*out, _cost(F.sum(F.when(F.col("parts").isNull() & F.col("cost_known"), F.col("cost_usd")))).alias("unattributed_usd"))


def _order() -> Column:
    return F.struct("ms", "id", "device")


def _newest(column: Column) -> Column:
    text = F.nullif(F.trim(column), F.lit(""))
    return F.max_by(text, F.when(text.isNotNull(), _order()))


def sessions(rows: DataFrame) -> DataFrame:
    """One row for each (device, harness, session_id); events without a session id belong to none."""
    thread = F.struct("thread_id", "thread_url")
    has = (F.coalesce("thread_id", F.lit("")) != "") | (F.coalesce("thread_url", F.lit("")) != "")
    found = rows.where("session_id <> ''").groupBy("device", "harness", "session_id").agg(
        F.min_by("project", _order()).alias("project"),
        F.min_by(F.struct("repository"), _order())["repository"].alias("repository"),
        F.min("ms").alias("started_ms"),
        F.max("ms").alias("last_active_ms"),
        F.array_join(F.sort_array(F.collect_set("model")), ", ").alias("model"),
        F.array_join(F.sort_array(F.collect_set("provider")), ", ").alias("provider"),
        _newest(F.col("session_title")).alias("session_title"),
        _newest(F.col("project_name")).alias("project_name"),
        F.max_by(thread, F.when(has, _order())).alias("thread"),
        *[t for t in totals()],
    )
    return found.select("*", F.col("thread.thread_id").alias("thread_id"), F.col("thread.thread_url").alias("thread_url")).drop("thread", "sessions")


def insights(rows: DataFrame) -> DataFrame:
    """Totals of each project with its raw paths, names and latest activity. Give rows without project filters."""
    name = F.nullif(F.trim("project_name"), F.lit(""))
    return rows.groupBy(F.col("project_key").alias("name")).agg(
        *totals(), F.array_join(F.sort_array(F.collect_set("project")), "\n").alias("paths"), F.array_join(F.sort_array(F.collect_set(name)), "\n").alias("project_names"), F.max("ms").alias("last_active_ms")
    )


def facets(rows: DataFrame, devices: tuple[str, ...] | None = None) -> DataFrame:
    """(facet, value) over all history, copies and future rows included; a device filter narrows all but devices.
    One aggregation over the distinct combinations."""
    combos = rows.groupBy("harness", "model", "provider", "project_key", "device").agg(F.lit(1).alias("one"))
    kept = F.lit(True) if devices is None else F.col("device").isin(*devices) if devices else F.lit(False)
    values = F.array(*[F.struct(F.lit(n).alias("facet"), F.col(c).alias("value"), (F.lit(True) if n == "device" else kept).alias("kept")) for n, c in DIMENSIONS.items()])
    return combos.select(F.explode(values).alias("f")).where("f.kept AND f.value IS NOT NULL").select("f.facet", "f.value").distinct()


def model_providers(rows: DataFrame, devices: tuple[str, ...] | None = None) -> DataFrame:
    """(model, provider) of all models in the facets."""
    kept = rows if devices is None else rows.where(F.col("device").isin(*devices)) if devices else rows.limit(0)
    return kept.select("model", "provider").distinct()


def dimension_counts(events: DataFrame) -> DataFrame:
    """Distinct tuples with their number of stored rows, from which facets can be kept up to date."""
    return events.groupBy(device().alias("device"), "harness", F.col("raw_model").alias("model"), project_key().alias("project")).agg(F.count("*").alias("records"))


def unresolved(rows: DataFrame) -> DataFrame:
    """Raw models with tokens that have no cost: what is missing (bits), and the tiers seen."""
    missing = rows.where("NOT cost_known AND tokens > 0")
    found = missing.groupBy("raw_model").agg(F.sum("tokens").alias("tokens"), F.bit_or("gaps").alias("gaps"), F.array_join(F.sort_array(F.collect_set(F.coalesce("service_tier", F.lit("")))), ",").alias("tiers"))
    return ranked(found, F.desc("tokens"), F.asc("raw_model"))


def source_status(files: DataFrame) -> DataFrame:
    """(harness, path, files, events, malformed, status) of files (harness, path, events, malformed, unreadable)."""
    found = files.groupBy("harness", "path").agg(F.count("*").alias("files"), F.sum("events").alias("events"), F.sum("malformed").alias("malformed"), F.sum(F.col("unreadable").cast("long")).alias("unreadable"))
    status = F.when(F.col("unreadable") == F.col("files"), "error").when(F.col("unreadable") + F.col("malformed") > 0, "partial").when(F.col("events") == 0, "empty").otherwise("ready")
    return found.withColumn("status", status)
