"""The parameters of a dashboard query, and the instants they stand for."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGES = ("today", "7d", "30d", "90d", "6m", "all")


@dataclass(frozen=True)
class UsageQuery:
    """A filter that is None lets everything pass, an empty one nothing. Excluded projects win over included ones."""

    range: str = "30d"
    timezone: str = "UTC"
    harnesses: tuple[str, ...] | None = None
    models: tuple[str, ...] | None = None
    providers: tuple[str, ...] | None = None
    projects: tuple[str, ...] | None = None
    excluded_projects: tuple[str, ...] | None = None
    devices: tuple[str, ...] | None = None

    def normalized(self) -> tuple[UsageQuery, list[str]]:
        """Lists sorted and without repeats; an unknown time zone becomes UTC, with a warning."""
        if self.range not in RANGES:
            raise ValueError(f"unknown range {self.range}")
        lists = {k: None if (v := getattr(self, k)) is None else tuple(sorted(set(v))) for k in ("harnesses", "models", "providers", "projects", "excluded_projects", "devices")}
        try:
            ZoneInfo(self.timezone)
        except (ZoneInfoNotFoundError, ValueError, OSError):
            return replace(self, timezone="UTC", **lists), [f"Unknown time zone {self.timezone}; using UTC"]
        return replace(self, **lists), []


def filter_text(values: tuple[str, ...] | None) -> str:
    """A filter as a URL parameter: '' for all, 'none' for nothing, else a comma list (JSON where a value needs it)."""
    import json

    if values is None:
        return ""
    if not values:
        return "none"
    plain = all("," not in v and not v.startswith("[") and v != "none" and v.strip() == v and v for v in values)
    return ",".join(values) if plain else json.dumps(list(values))


def filter_values(text: str | None) -> tuple[str, ...] | None:
    import json

    if not text:
        return None
    if text == "none":
        return ()
    if text.startswith("["):
        return tuple(str(v) for v in json.loads(text))
    return tuple(v for v in (x.strip() for x in text.split(",")) if v)


@dataclass(frozen=True)
class Timeframe:
    """Milliseconds since 1970. previous is None where there is no previous period."""

    now: int
    start: int
    end: int
    previous: int | None
    today: int
    zone: str
    days: tuple[tuple[date, int, int], ...]  # local date, its first instant, the next day's

    @property
    def hours(self) -> list[tuple[int, int]]:
        """Elapsed hours of today: 23 or 25 where clocks change."""
        return [(i, at) for i, at in enumerate(range(self.today, self.end, 3_600_000))]


def _ms(at: datetime) -> int:
    return (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)


def _at(wall: datetime, zone: ZoneInfo) -> int:
    """The instant of a local time: the earlier one where it occurs twice, moved ahead where it doesn't occur."""
    return _ms(wall.replace(tzinfo=zone).astimezone(UTC))


def _months_before(day: date, months: int) -> date:
    at = day.year * 12 + day.month - 1 - months
    first = date(at // 12, at % 12 + 1, 1)
    last = (date((at + 1) // 12, (at + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return first.replace(day=min(day.day, last))


def timeframe(query: UsageQuery, now: datetime, earliest: int | None = None) -> Timeframe:
    """`earliest`, the first instant of all events, matters to the range "all" only."""
    zone = ZoneInfo(query.timezone)
    wall = now.astimezone(zone).replace(tzinfo=None)
    midnight = datetime(wall.year, wall.month, wall.day)
    tomorrow = midnight + timedelta(days=1)
    today, end = _at(midnight, zone), _at(tomorrow, zone)
    previous: int | None
    if query.range == "today":
        first, start, previous = midnight.date(), today, _at(midnight - timedelta(days=1), zone)
    elif query.range == "all":
        oldest = min(_ms(now), earliest if earliest is not None else _ms(now))
        first = (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=oldest)).astimezone(zone).date()
        start, previous = _at(datetime(first.year, first.month, first.day), zone), None
    elif query.range == "6m":
        first = _months_before(tomorrow.date(), 6)
        before = _months_before(first, 6)
        start, previous = (_at(datetime(d.year, d.month, d.day), zone) for d in (first, before))
    else:
        length = timedelta(days=int(query.range[:-1]))
        start, previous = _at(wall - length, zone), _at(wall - 2 * length, zone)
        first = (wall - length).date()
    days, day = [], first
    while day <= midnight.date():
        edges = [_at(datetime(d.year, d.month, d.day), zone) for d in (day, day + timedelta(days=1))]
        days.append((day, *edges))
        day += timedelta(days=1)
    return Timeframe(_ms(now), start, end, previous, today, query.timezone, tuple(days))


def within(frame: Timeframe) -> Column:
    return (F.col("ms") >= frame.start) & (F.col("ms") < frame.end) & (F.col("ms") <= frame.now)


def before(frame: Timeframe) -> Column:
    if frame.previous is None:
        return F.lit(False)
    return (F.col("ms") >= frame.previous) & (F.col("ms") < frame.start) & (F.col("ms") <= frame.now)


def _among(name: str, values: tuple[str, ...] | None) -> Column:
    return F.lit(True) if values is None else F.lit(False) if not values else F.col(name).isin(*values)


def device_filter(query: UsageQuery) -> Column:
    return F.lit(True) if query.devices is None else F.lit(False) if not query.devices else F.coalesce("device_id", F.lit("local")).isin(*query.devices)


def project_filter(query: UsageQuery) -> Column:
    """By project key or raw path."""
    kept = _among("project_key", query.projects) | _among("project", query.projects)
    if query.excluded_projects:
        kept &= ~(_among("project_key", query.excluded_projects) | _among("project", query.excluded_projects))
    return kept


def dimension_filter(query: UsageQuery) -> Column:
    """All filters but those of devices, which apply before copies are removed, and of projects."""
    return _among("harness", query.harnesses) & _among("model", query.models) & _among("provider", query.providers)
