"""Running totals of live logs: what each line adds, as the lines arrive.

State is kept for each log file: the next line, the session, model, directory and tier that hold so far, and the counters of
the last total. Lines that arrive before their turn wait in the state until the lines before them have come, in parts that
are read and written one at a time, so that no task holds a log; lines that arrive again are passed over. So the rows are those of the batch reader in whatever order and portions lines come, and a
query that is started again carries on where its checkpoint ends.

Logs whose earlier lines depend on later ones can't be counted line by line: those of forked sessions, whose first lines are
copies, and those with records of single responses. Their lines from that point on give one row with needs_batch, and no
more rows; the batch reader counts them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from metergrid.functions.expr import log_millis, utc_iso
from metergrid.sources import logs

IN, OUT, TOTAL = (logs.COUNTS.index(c) for c in ("input_tokens", "output_tokens", "total_tokens"))
STATE = "next long, headed boolean, batch boolean, session string, model string, cwd string, tier string, before array<long>"
RESULT = "file string, line long, ms long, session_id string, model string, cwd string, tier string, tokens array<long>, needs_batch boolean"
#: Lines of a part of those that wait; rows that go on together.
PART, ROWS = 1024, 10_000


def _told(lines: DataFrame) -> DataFrame:
    """What each line tells, a row for every line, also for those that tell nothing."""
    short = F.when(F.octet_length("value") <= logs.MOST_BYTES, F.col("value"))
    rows = lines.select("file", "line", F.from_json(short, logs.CODEX).alias("r")).select("file", "line", "r", F.col("r.payload").alias("p"), log_millis(F.col("r.timestamp")).alias("ms"))
    kind = F.coalesce(F.when(F.col("r.type") == "event_msg", F.col("p.type")).otherwise(F.col("r.type")), F.lit(""))
    turn, meta = F.col("r.type") == "turn_context", F.col("r.type") == "session_meta"
    settings = (F.col("r.type") == "event_msg") & (kind == "thread_settings_applied")
    counts = lambda of: F.when(F.col(of).isNotNull(), F.array(*[logs.number(f"{of}.{c}") for c in logs.COUNTS]))
    counted = (F.col("r.type") == "event_msg") & (kind == "token_count") & F.col("ms").isNotNull() & F.col("p.info").isNotNull()
    forked = F.coalesce(logs.text("p.forked_from_id"), logs.text("p.parent_thread_id"), logs.text("p.source.subagent.thread_spawn.parent_thread_id")).isNotNull()
    return rows.select(
        "file", "line", "ms", meta.alias("meta"), (F.coalesce(meta & forked, F.lit(False)) | F.coalesce(F.col("r.type") == "token_usage_record", F.lit(False))).alias("batch"),
        F.when(meta, F.coalesce(logs.text("p.id"), logs.text("p.session_id"))).alias("session"), F.when(turn | meta, logs._codex_model("p")).alias("model"), F.when(turn | meta, logs.text("p.cwd")).alias("cwd"),
        F.when(turn, F.trim("p.service_tier")).when(settings, F.trim("p.thread_settings.service_tier")).alias("tier"), F.when(counted, F.coalesce(logs._codex_model("p"), logs._codex_model("p.info"))).alias("named"),
        F.when(counted, counts("p.info.total_token_usage")).alias("total"), F.when(counted, counts("p.info.last_token_usage")).alias("last"), logs.file_session().alias("of_file"),
    )


def added(total: list[int] | None, last: list[int] | None, before: list[int] | None) -> list[int] | None:
    """What a record adds: its own last usage, or the difference to the total before, or the total itself after a reset."""
    if total is None:
        return last
    if total == before:
        return None
    if last is not None:
        return last
    fell = before is None or total[IN] < before[IN] or total[OUT] < before[OUT] or 0 < total[TOTAL] < before[TOTAL]
    return total if fell else [max(0, a - b) for a, b in zip(total, before, strict=True)]


class Carry:
    """What holds after the lines of a log so far; `rows` gets what each of the next ones adds."""

    def __init__(self, file: str, held: tuple | None):
        self.file, self.rows = file, []
        self.at, self.headed, self.batch, self.session, self.model, self.cwd, self.tier, before = held or (1, False, False, None, None, None, None, None)
        self.before = None if before is None else list(before)

    def state(self) -> tuple:
        return self.at, self.headed, self.batch, self.session, self.model, self.cwd, self.tier, self.before

    def take(self, r: dict) -> None:
        """The line whose turn it is."""
        first = bool(r.get("meta")) and not self.headed
        if r.get("batch") and not self.batch and (first or not r.get("meta")):
            self.batch = True
            self.rows.append((self.file, self.at, None, None, None, None, None, None, True))
        if first:
            self.headed, self.session = True, r.get("session")
        if first or not r.get("meta"):
            self.model, self.cwd, self.tier = r.get("model") or self.model, r.get("cwd") or self.cwd, r["tier"] if "tier" in r else self.tier
        total, last = r.get("total"), r.get("last")
        if total is not None or last is not None:
            tokens = added(total, last, self.before)
            self.before = total if total is not None else self.before
            if tokens is not None and not self.batch:
                self.rows.append((self.file, self.at, int(r["ms"]), self.session or r["of_file"], r.get("named") or self.model, self.cwd, self.tier, tokens, False))
        self.at += 1

    def taken(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"line": "Int64", "ms": "Int64"})


class Counter(StatefulProcessor):
    """A log's lines in turn. Those that wait are kept in parts of PART lines, of which one at a time is in memory."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.carry = handle.getValueState("carry", STATE)
        self.waiting = handle.getMapState("waiting", "part long", "lines string")

    def _waiting(self, part: int) -> dict[int, dict]:
        held = self.waiting.getValue((part,))
        return {int(k): v for k, v in json.loads(held[0]).items()} if held else {}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        log = Carry(key[0], self.carry.get())
        for batch in rows:
            new: dict[int, dict[int, dict]] = {}
            for r in batch.to_dict("records"):
                if r["line"] >= log.at:
                    # pandas turns missing numbers and texts into NaN
                    told = {k: (v.tolist() if hasattr(v, "tolist") else v) for k, v in r.items() if k not in ("file", "line") and not (isinstance(v, float) and v != v) and v is not None}
                    new.setdefault(int(r["line"]) // PART, {})[int(r["line"])] = told
            part = log.at // PART
            while part == log.at // PART:
                before = self._waiting(part)
                held = before | new.pop(part, {})
                while log.at in held:
                    log.take(held.pop(log.at))
                if len(log.rows) >= ROWS:
                    yield log.taken()
                if held:
                    self.waiting.updateValue((part,), (json.dumps(held),))
                elif before:
                    self.waiting.removeKey((part,))
                # on, if its last line was taken
                part += 1
            for part, some in new.items():
                self.waiting.updateValue((part,), (json.dumps(self._waiting(part) | some),))
        self.carry.update(log.state())
        if log.rows:
            yield log.taken()


def counted(lines: DataFrame) -> DataFrame:
    """A stream of (file, line, value), every line from 1 on, to (file, line, needs_batch) and the columns of candidates
    that a running total has."""
    # state of several parts needs this store
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = _told(lines).groupBy("file").transformWithStateInPandas(Counter(), RESULT, "append", "None")
    n = lambda c: F.get("tokens", F.lit(logs.COUNTS.index(c)))
    split = logs._split_cache(n("input_tokens"), n("cached_input_tokens"), F.greatest(n("cache_write_input_tokens"), n("cache_creation_input_tokens")), n("output_tokens"), n("reasoning_output_tokens"))
    rows = found.select("file", "line", "ms", "session_id", "needs_batch", logs.model_name(F.col("model")).alias("raw_model"), logs.project_name(F.col("cwd")).alias("project"), F.coalesce("tier", F.lit("")).alias("service_tier"), *split)
    columns = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens")
    # the id of the batch reader
    name = F.sha2(logs.json_list(logs.quoted(F.col("session_id")), logs.quoted(utc_iso(F.col("ms"))), *[F.col(c).cast("string") for c in columns]), 256)
    return rows.where(f"needs_batch OR {logs.TOTAL}").withColumn("id", F.concat(F.lit("codex:total:"), name))
