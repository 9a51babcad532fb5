"""Reports of sessions and totals, and intervals of one's own."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metergrid.functions import expr

# The columns of a session export.
EXPORT = (
    "session", "harness", "models", "project", "repository", "device", "tokens", "estimated_cost_usd", "unpriced_tokens", "last_active", "session_title", "project_name", "t3_thread_id", "t3_thread_url",
    "t3_native_thread_url", "repository_url", "cursor_agent_url",
)


def session_export(sessions: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """Sessions as quoted cells of a CSV file; devices (id, name) give names to ids."""
    named = sessions if devices is None else sessions.join(devices.select(F.col("id").alias("device"), F.col("name").alias("_name")), "device", "left")
    cost = F.regexp_replace(F.round("cost_usd", 9).cast("decimal(30,9)").cast("string"), r"\.?0+$", "")
    device = F.col("device") if devices is None else F.coalesce("_name", "device")
    cells = [
        F.col("session_id"), F.col("harness"), F.col("model"), F.col("project"), F.col("repository"), device, F.col("tokens"), cost, F.col("unpriced_tokens"), expr.utc_iso(F.col("last_active_ms")), F.col("session_title"),
        F.col("project_name"), F.col("thread_id"), expr.safe_web_url(F.col("thread_url")), expr.native_thread_url(F.col("thread_id"), F.col("thread_url"), "t3code"), expr.repository_url(F.col("repository")), expr.agent_url(F.col("harness"), F.col("session_id")),
    ]
    return named.select(*[expr.csv_cell(c).alias(n) for n, c in zip(EXPORT, cells, strict=True)])


def custom_interval(rows: DataFrame, now: datetime, days: int | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Rows from `since` (or `days`, 30 if not given, before the end) to `until` (or now), which a report then takes whole."""
    if days is not None and not 0 < days <= 36_500:
        raise ValueError("days must be between 1 and 36500")
    ms = lambda t: int(t.astimezone(UTC).timestamp() * 1000)
    end = ms(until or now)
    start = ms(since) if since else end - (days or 30) * 86_400_000
    if start >= end:
        raise ValueError("since must be before until")
    return rows.where((F.col("ms") >= start) & (F.col("ms") < end))


def _line(name: Column, tokens: Column, cost: Column) -> Column:
    return F.concat(F.lit("  "), F.rpad(name, 26, " "), F.lit(" "), F.lpad(F.format_number(tokens, 0), 16, " "), F.lit(" tokens  "), F.lpad(F.concat(F.lit("$"), F.format_number(cost, 2)), 12, " "))


def report_lines(harnesses: DataFrame, models: DataFrame, top: int = 5) -> DataFrame:
    """(part, place, line) of a text report: all harnesses, and the models with most tokens."""
    lines = lambda rows, part: rows.select(F.lit(part).alias("part"), F.row_number().over(Window.orderBy(F.desc("tokens"), F.asc("name"))).alias("place"), _line(F.col("name"), F.col("tokens"), F.col("cost_usd")).alias("line"))
    return lines(harnesses, "Harnesses").union(lines(models.orderBy(F.desc("tokens"), F.asc("name")).limit(top), "Top models"))


def shown_warnings(warnings: list[str], unpriced_tokens: int) -> list[str]:
    """Without those on missing prices where all tokens have one."""
    return [w for w in warnings if unpriced_tokens > 0 or not w.startswith("No reliable API price")]


def canonical_order(events: DataFrame) -> DataFrame:
    """Events by time and id: a range-partitioned sort."""
    return events.orderBy("ms", "id")
