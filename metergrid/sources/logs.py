"""Agent logs to candidate rows. Only accounting fields are read; message texts never leave the scan.

Each reader takes lines (file, line, value): one JSON record each, as read_lines() makes them, parses a record once, and
returns candidates: the fact columns and file, line, sidechain, native_id, parent_id and legacy_id. files() has what is
known of a file as a whole. State that runs through a log (context, counters) is carried within and over its segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metergrid.functions.expr import log_millis, utc_iso
from metergrid.tables import written

CANDIDATE = {
    "id": "string", "ms": "long", "harness": "string", "raw_model": "string", "project": "string", "session_id": "string", "input_tokens": "long", "output_tokens": "long", "cache_read_tokens": "long", "cache_write_tokens": "long",
    "reasoning_tokens": "long", "cache_write_1h_tokens": "long", "service_tier": "string", "reported_cost_usd": "double", "requests": "int", "sidechain": "boolean", "native_id": "string", "parent_id": "string",
    "legacy_id": "string", "file": "string", "line": "long",
}
#: Bytes of the longest record that is read, and lines of a log that one task takes together.
MOST_BYTES = 32 << 20
SEGMENT = 1 << 16
#: Stands for a line that can't be read.
MALFORMED = "!"
UNKNOWN_PROJECT = "Unknown project"


def read_lines(spark: SparkSession, path: str, fields: str | None = None) -> DataFrame:
    """(file, line, value) of every *.jsonl below path, with the line's number in its file.

    Large files are read in splits by several tasks. A task numbers the lines of a split; the numbers of lines in the
    splits before, and so a line's number in its file, follow from the count of each split. That needs a table of what was
    read, since two scans may split files in different ways. With `fields`, the schema that a reader parses, the table and
    the values hold these fields alone, and no message text is stored. A record of more than MOST_BYTES, or one that is no
    JSON object, keeps its line and counts as malformed. A last line without line feed may still be written: it counts if
    it is a whole object, and isn't malformed otherwise."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("lineSep", "\n").text(path)
    size = F.octet_length("value")
    fits = size <= MOST_BYTES
    whole = fits & F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{")
    value = F.when(fits, F.col("value")).otherwise(MALFORMED) if fields is None else F.when(F.trim("value") == "", "").when(whole, _reduced(fields)).otherwise(MALFORMED)
    m = "_metadata"
    read = raw.select(
        F.col(f"{m}.file_path").alias("file"), F.col(f"{m}.file_block_start").alias("block"), F.col(f"{m}.file_size").alias("length"), (size + 1).cast("long").alias("size"), F.monotonically_increasing_id().alias("at"), whole.alias("whole"), value.alias("value"),
    )
    read = written(read, "lines")
    splits = read.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("length").alias("length"))
    every, before = Window.partitionBy("file"), Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(every).alias("lines"), (F.sum("bytes").over(every) > F.col("length")).alias("open"))
    found = read.select("file", "block", "at", "whole", "value").join(splits, ["file", "block"]).withColumn("line", F.col("before") + F.col("at") - F.col("first") + 1)
    unfinished = F.col("open") & (F.col("line") == F.col("lines")) & ~F.col("whole")
    return found.where((F.trim("value") != "") & ~unfinished).select("file", "line", "value")


def _reduced(fields: str) -> Column:
    """The record with these fields alone, as JSON. An ordinal keeps its kind."""
    schema = T.StructType.fromDDL(fields)
    kept = [F.from_json("value", schema)[f.name].alias(f.name) for f in schema if f.name not in ("ordinal", "sequence")]
    return F.to_json(F.struct(*kept, *[F.try_variant_get(F.try_parse_json("value"), f"$.{c}", "variant").alias(c) for c in ("ordinal", "sequence")]))


def malformed(lines: DataFrame) -> DataFrame:
    """(file, lines, malformed): lines that are too long, no JSON or no object."""
    bad = (F.octet_length("value") > MOST_BYTES) | F.try_parse_json("value").isNull() | ~F.ltrim("value").startswith("{")
    return lines.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(bad).alias("malformed"))


def carried_over(rows: DataFrame, columns: dict[str, Column], keys: list[str], order: list[str], strictly: bool = False) -> DataFrame:
    """rows with each of `columns` as the last value that isn't null up to the row (strictly: before it), in the order of
    a log. order[0] is the line. A log is cut into segments of SEGMENT lines: values are carried within segments, the last
    value of each segment over the segments, and what a segment starts with into its rows. So no task holds a whole log."""
    cut = rows.withColumns({f"_v_{n}": c for n, c in columns.items()}).withColumn("_part", F.floor(F.col(order[0]) / SEGMENT))
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strictly else Window.currentRow)
    own = cut.withColumns({f"_o_{n}": F.last(f"_v_{n}", ignorenulls=True).over(within) for n in columns})
    last = [F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*order))).alias(f"_v_{n}") for n in columns]
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*keys, "_part").agg(*last).select(*keys, "_part", *[F.last(f"_v_{n}", ignorenulls=True).over(earlier).alias(f"_s_{n}") for n in columns])
    kept = [c for c in rows.columns if c not in columns]
    return own.join(starts, [*keys, "_part"], "left").select(*kept, *[F.coalesce(f"_o_{n}", f"_s_{n}").alias(n) for n in columns])


def numbered(rows: DataFrame, keys: list[str], line: str, out: str) -> DataFrame:
    """rows with `out`, 1 for the first of each log by `line`, counted within segments and over them."""
    cut = rows.withColumn("_part", F.floor(F.col(line) / SEGMENT))
    own = cut.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(line)))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*keys, "_part").agg(F.count("*").alias("_c")).select(*keys, "_part", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    return own.join(starts, [*keys, "_part"]).withColumn(out, (F.col("_before") + F.col("_n")).cast("long")).drop("_part", "_n", "_before")


def carried(column: str, keys: list[str], order: list[str]) -> Column:
    """The last value that isn't null up to each row."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _fell(now, before, counters: list[str], total: str | None) -> Column:
    """No counter before, or one that fell; a total counts only where both are above 0."""
    reset = before(counters[0]).isNull()
    for c in counters:
        reset = reset | ((now(c) < before(c)) & (F.lit(True) if c != total else (now(c) > 0) & (before(c) > 0)))
    return reset


def counter_deltas(rows: DataFrame, keys: list[str], order: list[str], counters: list[str], total: str | None = None) -> DataFrame:
    """Running counters to what each row adds: the difference to the row before, or the counter itself after a reset
    (there is no row before, or one of the counters fell; a `total` of 0 is a missing one). Rows that add nothing have
    all differences 0."""
    over = Window.partitionBy(*keys).orderBy(*order)
    before = rows.withColumns({f"_{c}": F.lag(c).over(over) for c in counters})
    reset = _fell(F.col, lambda c: F.col(f"_{c}"), counters, total)
    return before.select(*rows.columns, *[F.when(reset, F.col(c)).otherwise(F.greatest(F.lit(0), F.col(c) - F.col(f"_{c}"))).alias(f"{c}_delta") for c in counters])


def text(name: str) -> Column:
    """A trimmed text, null where there is none."""
    return F.nullif(F.trim(name), F.lit(""))


def number(name: str | Column) -> Column:
    """A counter of a log: whole and not negative; what is no number is 0."""
    return F.coalesce(F.greatest(F.lit(0), F.col(name) if isinstance(name, str) else name).cast("long"), F.lit(0).cast("long"))


def model_name(name: Column) -> Column:
    return F.when(name.isNull() | (name == "<synthetic>"), "unknown").otherwise(name)


def project_name(name: Column) -> Column:
    return F.coalesce(name, F.lit(UNKNOWN_PROJECT))


def file_session(file: str = "file") -> Column:
    name = F.element_at(F.split(file, r"[\\/]"), -1)
    return F.coalesce(F.nullif(F.regexp_replace(name, r"(?i)\.jsonl$", ""), F.lit("")), F.lit("unknown"))


def json_list(*values: Column) -> Column:
    """The values as compact JSON; texts are quoted."""
    return F.concat(F.lit("["), F.concat_ws(",", *values), F.lit("]"))


def quoted(value: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")


def fallback_id(harness: str, session: Column, ms: Column, ordinal: Column, line: Column) -> Column:
    """An id for records without one. ordinal: JSON text of the record's own ordinal, null if it has none."""
    return F.concat(F.lit(f"{harness}:metadata:"), F.sha2(json_list(quoted(session), quoted(utc_iso(ms)), F.coalesce(ordinal, line.cast("string"))), 256))


def ordinal_text(value: str, path: str = "$.ordinal") -> Column:
    """JSON text of a number or of a text that isn't empty, else null."""
    found = F.try_variant_get(F.try_parse_json(value), path, "variant")
    kind = F.schema_of_variant(found)
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.to_json(found)).when((kind == "STRING") & (F.to_json(found) != '""'), F.to_json(found))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is computed once a row. Spark copies what a projection computes into each filter and column
    that uses it, so that a record would be parsed again for every condition; what explode() gives isn't copied."""
    return rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """(file, line, value, r): records as structs of the fields that are read; lines that are no objects are left out."""
    lines = once(lines.select("file", "line", "value"), "value", F.col("value"))
    short = lines.where((F.octet_length("value") <= MOST_BYTES) & F.ltrim("value").startswith("{"))
    return once(short, "r", F.from_json("value", schema)).where("r IS NOT NULL")


TOTAL = "input_tokens + output_tokens + cache_read_tokens + cache_write_tokens > 0"


def _finish(rows: DataFrame, harness: str) -> DataFrame:
    have = set(rows.columns)
    fixed = {"harness": F.lit(harness), "sidechain": F.coalesce("sidechain", F.lit(False)) if "sidechain" in have else F.lit(False)}
    return rows.select(*[fixed[c].alias(c) if c in fixed else (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in CANDIDATE.items()]).where("ms IS NOT NULL AND id IS NOT NULL")


def _split_cache(total_in: Column, cached: Column, into: Column, out: Column, reasoning: Column) -> list[Column]:
    """Input logs that count cache tokens within input: read, write and fresh input, reasoning within output."""
    read = F.least(cached, total_in)
    write = F.least(into, total_in - read)
    return [(total_in - read - write).alias("input_tokens"), read.alias("cache_read_tokens"), write.alias("cache_write_tokens"), out.alias("output_tokens"), F.least(reasoning, out).alias("reasoning_tokens")]


_INNER = """input_tokens: DOUBLE, output_tokens: DOUBLE, cache_read_input_tokens: DOUBLE, cache_creation_input_tokens: DOUBLE, speed: STRING, service_tier: STRING,
cache_creation: STRUCT<ephemeral_1h_input_tokens: DOUBLE, ephemeral_5m_input_tokens: DOUBLE>, output_tokens_details: STRUCT<thinking_tokens: DOUBLE, reasoning_tokens: DOUBLE>"""
CLAUDE = f"""type STRING, timestamp STRING, sessionId STRING, uuid STRING, requestId STRING, cwd STRING, isSidechain BOOLEAN,
message STRUCT<id: STRING, model: STRING, usage: STRUCT<{_INNER}, iterations: ARRAY<STRUCT<type: STRING, model: STRING, {_INNER}>>>>"""


def _claude_records(lines: DataFrame) -> DataFrame:
    """Assistant records with usage, their ids and calls: the record's own and those of advisors within it."""
    rows = parsed(lines, CLAUDE).where("r.type = 'assistant' AND r.message.usage IS NOT NULL AND NOT coalesce(r.message.model = '<synthetic>', false)")
    u = "r.message.usage"
    rows = rows.select(
        "file", "line", "r", log_millis(F.col("r.timestamp")).alias("ms"), F.coalesce(text("r.sessionId"), file_session()).alias("session_id"), text("r.message.id").alias("native_id"), (F.coalesce("r.isSidechain", F.lit(False))).alias("sidechain"),
        ordinal_text("value").alias("ordinal"), F.when(F.col(f"{u}.speed") == "fast", "priority").otherwise(F.coalesce(text(f"{u}.service_tier"), F.lit(""))).alias("tier"),
    ).where("ms IS NOT NULL")
    whole = F.concat(F.lit("claude:message:"), "native_id", F.lit(":"), F.coalesce(text("r.requestId"), F.lit("")))
    record = F.coalesce(whole, F.concat(F.lit("claude:uuid:"), text("r.uuid")), fallback_id("claude", F.col("session_id"), F.col("ms"), F.col("ordinal"), F.col("line")))
    rows = rows.withColumn("record_id", record)
    fields = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "speed", "service_tier", "cache_creation", "output_tokens_details")
    own = F.array(F.struct(F.lit(None).cast("string").alias("type"), F.col("r.message.model").alias("model"), *[F.col(f"{u}.{f}").alias(f) for f in fields], F.lit(-1).alias("at"), F.lit(-1).alias("advisor")))
    # an advisor's number counts advisors only; its place counts all calls
    numbered = F.transform(F.coalesce(F.col(f"{u}.iterations"), F.array()), lambda x, i: F.struct(*[x[f].alias(f) for f in ("type", "model", *fields)], i.alias("at")))
    advisors = F.transform(F.filter(numbered, lambda x: x["type"] == "advisor_message"), lambda x, i: F.struct(*[x[f].alias(f) for f in ("type", "model", *fields, "at")], i.alias("advisor")))
    named = F.filter(advisors, lambda x: (F.trim(F.coalesce(x["model"], F.lit(""))) != "") & (F.trim(x["model"]) != "<synthetic>"))
    return rows.withColumn("calls", F.concat(own, named))


def claude(lines: DataFrame) -> DataFrame:
    """Assistant records with usage. Advisor calls inside a record are rows of their own, owned by the record."""
    return claude_calls(lines).where(TOTAL)


def claude_calls(lines: DataFrame) -> DataFrame:
    """The rows of claude(), and those that bill nothing."""
    rows = _claude_records(lines).select("file", "line", "ms", "session_id", "native_id", "sidechain", "tier", "record_id", F.col("r.cwd").alias("cwd"), F.explode("calls").alias("c"))
    hour, advisor = number("c.cache_creation.ephemeral_1h_input_tokens"), F.col("c.advisor") >= 0
    write = F.greatest(number("c.cache_creation_input_tokens"), hour + number("c.cache_creation.ephemeral_5m_input_tokens"))
    of = lambda n: F.concat(F.lit("claude:advisor:"), F.sha2(json_list(quoted(F.col("record_id")), F.col(n).cast("string")), 256))
    out = rows.select(
        "file", "line", "ms", "session_id", "native_id", "sidechain", F.when(advisor, of("c.advisor")).otherwise(F.col("record_id")).alias("id"), F.when(advisor, F.col("record_id")).alias("parent_id"),
        F.when(advisor & (F.col("c.at") != F.col("c.advisor")), of("c.at")).alias("legacy_id"), model_name(text("c.model")).alias("raw_model"), project_name(text("cwd")).alias("project"),
        number("c.input_tokens").alias("input_tokens"), number("c.output_tokens").alias("output_tokens"), number("c.cache_read_input_tokens").alias("cache_read_tokens"), write.alias("cache_write_tokens"),
        F.least(write, hour).alias("cache_write_1h_tokens"), F.least(number("c.output_tokens"), F.greatest(number("c.output_tokens_details.thinking_tokens"), number("c.output_tokens_details.reasoning_tokens"))).alias("reasoning_tokens"),
        F.when(F.col("c.speed") == "fast", "priority").otherwise(F.coalesce(text("c.service_tier"), "tier")).alias("service_tier"),
    )
    return _finish(out, "claude")


def claude_empty(lines: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """(native_id, session_id, id) of main requests of which no record of their file bills anything: they own their
    replays, though they aren't billed. One row, also where several files hold the request. calls: claude_calls(lines), if
    there is a table of them."""
    rows = claude_calls(lines) if calls is None else calls
    rows = rows.select("file", F.coalesce("parent_id", "id").alias("id"), "native_id", "session_id", F.expr("parent_id IS NULL AND native_id IS NOT NULL AND NOT sidechain").alias("main"), F.expr(TOTAL).alias("bills"))
    each = rows.groupBy("file", "id", "native_id", "session_id", "main").agg(F.bool_or("bills").alias("bills"))
    some = F.max("bills").over(Window.partitionBy("file", "id"))
    return each.withColumn("some", some).where("main AND NOT some").select("native_id", "session_id", "id").distinct()


_COUNTS = "input_tokens: DOUBLE, cached_input_tokens: DOUBLE, cache_write_input_tokens: DOUBLE, cache_creation_input_tokens: DOUBLE, output_tokens: DOUBLE, reasoning_output_tokens: DOUBLE, total_tokens: DOUBLE"
_NAMED = "model: STRING, model_name: STRING, metadata: STRUCT<model: STRING>"
CODEX = f"""type STRING, timestamp STRING, ordinal DOUBLE, payload STRUCT<type: STRING, id: STRING, session_id: STRING, forked_from_id: STRING, parent_thread_id: STRING, timestamp: STRING, cwd: STRING, service_tier: STRING,
turn_id: STRING, thread_id: STRING, response_id: STRING, compaction_response_id: STRING, started_at: STRING, subagent_history_start_ordinal: DOUBLE, {_NAMED},
source: STRUCT<subagent: STRUCT<thread_spawn: STRUCT<parent_thread_id: STRING>>>, thread_settings: STRUCT<service_tier: STRING>, usage: STRUCT<{_COUNTS}>, thread_token_usage: STRUCT<{_COUNTS}>,
info: STRUCT<total_token_usage: STRUCT<{_COUNTS}>, last_token_usage: STRUCT<{_COUNTS}>, {_NAMED}>>"""
COUNTS = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "cache_creation_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
UUID7 = "^(?i)[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def _codex_model(of: str) -> Column:
    return F.coalesce(text(f"{of}.model"), text(f"{of}.model_name"), text(f"{of}.metadata.model"))


def _counts(of: str) -> Column:
    return F.when(F.col(of).isNotNull(), F.struct(*[number(f"{of}.{c}").alias(c) for c in COUNTS]))


def _codex_rows(lines: DataFrame) -> DataFrame:
    """Records with the context that holds at each: model, directory and tier so far."""
    rows = parsed(lines, CODEX).select("file", "line", ordinal_text("value").alias("ordinal"), "r", F.col("r.payload").alias("p"), log_millis(F.col("r.timestamp")).alias("ms"))
    kind = F.when(F.col("r.type") == "event_msg", F.col("p.type")).otherwise(F.col("r.type"))
    rows = rows.withColumns({"kind": F.coalesce(kind, F.lit("")), "meta": F.when(F.col("r.type") == "session_meta", F.col("line"))})
    heads = rows.groupBy("file").agg(F.min("meta").alias("head_line"))
    rows = rows.join(heads, "file").withColumn("head", F.coalesce(F.col("line") == F.col("head_line"), F.lit(False))).drop("head_line")
    turn = F.col("r.type") == "turn_context"
    settings = (F.col("r.type") == "event_msg") & (F.col("kind") == "thread_settings_applied")
    context = {
        "c_model": F.when(turn | F.col("head"), _codex_model("p")), "c_cwd": F.when(turn | F.col("head"), text("p.cwd")),
        "c_tier": F.when(turn, F.trim("p.service_tier")).when(settings, F.trim("p.thread_settings.service_tier")),
    }
    return carried_over(rows, context, ["file"], ["line"])


def codex_files(lines: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(file, session_id, parent_id, forked_ms, history_start, boundary) of each file. boundary: the line of the first
    task of its own, where earlier lines are copies from its parent; beyond all lines, if there is none."""
    rows = _codex_rows(lines) if rows is None else rows
    heads = rows.where("head").select(
        "file", F.coalesce(text("p.id"), text("p.session_id")).alias("own"), F.coalesce(text("p.forked_from_id"), text("p.parent_thread_id"), text("p.source.subagent.thread_spawn.parent_thread_id")).alias("parent_id"),
        F.coalesce(log_millis(F.col("p.timestamp")), "ms").alias("forked_ms"), F.col("p.subagent_history_start_ordinal").alias("history_start"),
    )
    known = rows.select("file").distinct().join(heads, "file", "left").withColumn("session_id", F.coalesce("own", file_session())).drop("own")
    tasks = rows.where("kind = 'task_started'").join(known.where("parent_id IS NOT NULL AND forked_ms IS NOT NULL"), "file")
    started, turn_id = log_millis(F.col("p.started_at")), F.trim("p.turn_id")
    of_turn = F.when(turn_id.rlike(UUID7), F.conv(F.concat(F.substring(turn_id, 1, 8), F.substring(turn_id, 10, 4)), 16, 10).cast("long"))
    by_turn = of_turn.isNotNull() & (started.isNull() | (F.floor(of_turn / 1000) == F.floor(started / 1000)))
    whole = F.col("p.started_at").rlike("^[0-9]+$") & (F.col("p.started_at").try_cast("double") <= 1e11)
    unit = F.when(by_turn, 1).when(whole, 1000).otherwise(1)
    at = F.when(by_turn, of_turn).otherwise(started)
    tasks = tasks.select("file", "line", (F.floor(at / unit) < F.floor(F.col("forked_ms") / unit)).alias("copied")).where("copied IS NOT NULL")
    first = tasks.groupBy("file").agg(F.min(F.when(~F.col("copied"), F.col("line"))).alias("native"), F.min(F.when(F.col("copied"), F.col("line"))).alias("inherited"))
    again = rows.where("r.type = 'session_meta' AND NOT head").select("file", text("p.id").alias("parent_id")).join(known.select("file", "parent_id"), ["file", "parent_id"]).select("file", F.lit(True).alias("ancestry")).distinct()
    every = known.join(first, "file", "left").join(again, "file", "left")
    inherited = F.col("inherited").isNotNull() & (F.col("native").isNull() | (F.col("inherited") < F.col("native")))
    boundary = F.when(F.col("parent_id").isNotNull() & (F.coalesce("ancestry", F.lit(False)) | inherited), F.coalesce("native", F.when(inherited, F.lit((1 << 62)))))
    return every.select("file", "session_id", "parent_id", "forked_ms", "history_start", boundary.alias("boundary"))


def codex(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates, and the ids (id, file) that a collection withdraws: copied requests of a parent.

    Running totals give what each adds. Records of single responses that name their thread are authoritative from the
    first one on; others count only for compactions, unless a running total already holds them."""
    rows = written(_codex_rows(lines), "codex")  # accounting fields only, read by each step below
    files = written(codex_files(lines, rows), "codex-files")
    u, info = "p.usage", "p.info"
    rows = rows.where("kind IN ('token_count', 'token_usage_record', 'compacted', 'turn_context')").join(files, "file")
    dated = rows.where("ms IS NOT NULL")
    early = F.coalesce(F.col("r.ordinal") < F.col("history_start"), F.lit(False))
    totals = dated.where(f"kind = 'token_count' AND r.type = 'event_msg' AND {info} IS NOT NULL").withColumns({"total": _counts(f"{info}.total_token_usage"), "last": _counts(f"{info}.last_token_usage")})
    totals = carried_over(totals, {"before": F.col("total")}, ["file"], ["line"], strictly=True)
    fell = _fell(lambda c: F.col(f"total.{c}"), lambda c: F.col(f"before.{c}"), ["input_tokens", "output_tokens", "total_tokens"], "total_tokens")
    delta = F.when(fell, F.col("total")).otherwise(F.struct(*[F.greatest(F.lit(0).cast("long"), F.col(f"total.{c}") - F.col(f"before.{c}")).alias(c) for c in COUNTS]))
    added = F.when(F.col("total").isNull(), F.col("last")).when(~F.col("total").eqNullSafe(F.col("before")), F.coalesce("last", delta))
    columns = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens")
    split = lambda t: _split_cache(F.col(f"{t}.input_tokens"), F.col(f"{t}.cached_input_tokens"), F.greatest(f"{t}.cache_write_input_tokens", f"{t}.cache_creation_input_tokens"), F.col(f"{t}.output_tokens"), F.col(f"{t}.reasoning_output_tokens"))
    snapshots = totals.withColumn("tokens", added).where(F.col("tokens").isNotNull() & ~early).select(
        "file", "line", "ms", "session_id", "boundary", "tokens", "total", model_name(F.coalesce(_codex_model("p"), _codex_model(info), "c_model")).alias("raw_model"), project_name(F.col("c_cwd")).alias("project"), F.coalesce("c_tier", F.lit("")).alias("service_tier"), *split("tokens")
    ).where(TOTAL)
    snapshots = snapshots.withColumn("id", F.concat(F.lit("codex:total:"), F.sha2(json_list(quoted(F.col("session_id")), quoted(utc_iso(F.col("ms"))), *[F.col(c).cast("string") for c in columns]), 256)))
    thread = text("p.thread_id")
    single = dated.where(f"kind = 'token_usage_record' AND r.type = 'token_usage_record' AND {u} IS NOT NULL").where(~early & (thread.isNull() | (thread == F.col("session_id")))).withColumn("tokens", _counts(u))
    single = single.select(
        "file", "line", "ms", "session_id", "boundary", "tokens", _counts("p.thread_token_usage").alias("thread_total"), thread.alias("thread"), text("p.response_id").alias("response"), text("p.turn_id").alias("turn"), _codex_model("p").alias("named"),
        F.col("c_model"), F.col("c_cwd"), F.coalesce(text("p.service_tier"), "c_tier", F.lit("")).alias("service_tier"), "ordinal", *split("tokens"),
    ).where(TOTAL)
    single = single.withColumn("id", F.coalesce(F.concat(F.lit("codex:response:"), "response"), fallback_id("codex", F.col("session_id"), F.col("ms"), F.col("ordinal"), F.col("line"))))
    marks = rows.where("kind = 'compacted'").groupBy("file", text("p.compaction_response_id").alias("response")).agg(F.min("line").alias("mark")).where("response IS NOT NULL")
    single = written(single.join(marks, ["file", "response"], "left"), "codex-single")
    first = single.where("thread IS NOT NULL AND mark IS NULL").groupBy("file").agg(F.min("ms").alias("first_ms"))
    snapshots = written(snapshots.join(first, "file", "left").where("first_ms IS NULL OR ms < first_ms").drop("first_ms"), "codex-totals")
    # a snapshot belongs to the last single record before it
    both = snapshots.select("file", "line", F.lit(None).cast("long").alias("s")).union(single.select("file", "line", F.col("line").alias("s")))
    owner = carried_over(both, {"after": F.col("s")}, ["file"], ["line"], strictly=True).where("s IS NULL AND after IS NOT NULL").select("file", "line", "after")
    held = snapshots.join(owner, ["file", "line"]).select("file", F.col("line").alias("at"), "after", F.col("tokens").alias("has"), F.col("total").alias("sum"))
    waiting = single.where("mark IS NOT NULL AND NOT (thread IS NULL AND boundary IS NOT NULL AND line < boundary)").select("file", F.col("line").alias("after"), F.col("id").alias("native"), "mark", "tokens", "thread_total")
    same = (F.col("has") == F.col("tokens")) | F.coalesce(F.col("sum") == F.col("thread_total"), F.lit(False))
    covered = held.join(waiting, ["file", "after"]).where(same & (F.col("at") < F.col("mark"))).groupBy("file", "after").agg(F.min_by("native", "at").alias("native"), F.min("at").alias("line"))
    copied = "boundary IS NOT NULL AND line < boundary"
    kept = snapshots.where(f"NOT ({copied})").join(covered.select("file", "line", "native"), ["file", "line"], "left").withColumn("id", F.coalesce("native", "id"))
    counted = single.where(f"(thread IS NOT NULL OR mark IS NOT NULL) AND NOT (thread IS NULL AND {copied})").join(covered.select("file", F.col("after").alias("line")), ["file", "line"], "left_anti")
    turns = rows.where("kind = 'turn_context'").select("file", text("p.turn_id").alias("turn"), "line", "c_model", "c_cwd", "c_tier").where("turn IS NOT NULL").groupBy("file", "turn").agg(F.max_by(F.struct("c_model", "c_cwd", "c_tier"), "line").alias("t"))
    counted = counted.join(turns, ["file", "turn"], "left")
    of_turn = lambda c: F.when(F.col("t").isNotNull(), F.col(f"t.{c}")).otherwise(F.col(c))
    counted = counted.withColumns({"raw_model": model_name(F.coalesce("named", of_turn("c_model"))), "project": project_name(of_turn("c_cwd")), "service_tier": F.coalesce(F.nullif("service_tier", F.lit("")), "t.c_tier", F.lit(""))})
    withdrawn = snapshots.where(copied).select("id", "file").union(single.where(f"thread IS NULL AND mark IS NOT NULL AND {copied}").select("id", "file"))
    return _finish(kept, "codex").union(_finish(counted, "codex")), withdrawn.distinct()


PI = """type STRING, timestamp STRING, id STRING, cwd STRING, parentSession STRING, modelId STRING, message STRUCT<role: STRING, model: STRING,
usage: STRUCT<input: DOUBLE, output: DOUBLE, cacheRead: DOUBLE, cacheWrite: DOUBLE, cacheWrite1h: DOUBLE, reasoning: DOUBLE>>"""


def _pi_rows(lines: DataFrame) -> DataFrame:
    rows = parsed(lines, PI).withColumn("ms", log_millis(F.col("r.timestamp")))
    head = F.col("r.type") == "session"
    used = (F.col("r.type") == "message") & (F.col("r.message.role") == "assistant") & F.col("r.message.usage").isNotNull() & F.col("ms").isNotNull()
    carried_on = {
        "session": F.when(head, text("r.id")), "directory": F.when(head, F.coalesce(text("r.cwd"), F.lit(""))),
        "parent": F.when(head, F.coalesce(F.element_at(F.split(F.regexp_replace(F.element_at(F.split(F.trim("r.parentSession"), r"[\\/]"), -1), r"(?i)\.jsonl$", ""), "_"), -1), F.lit(""))),
        "forked": F.when(head, F.coalesce(F.when(text("r.parentSession").isNotNull(), F.col("ms")), F.lit(0))), "model": F.when(F.col("r.type") == "model_change", model_name(text("r.modelId"))).when(used, text("r.message.model")),
    }
    return carried_over(rows.withColumn("used", used), carried_on, ["file"], ["line"])


def pi(lines: DataFrame) -> DataFrame:
    """Assistant messages; model changes and the session's header carry forward. native_id is the entry's own id."""
    u = lambda n: number(f"r.message.usage.{n}")
    out = _pi_rows(lines).where("used").select(
        "file", "line", "ms", F.coalesce("session", file_session()).alias("session_id"), project_name(F.nullif("directory", F.lit(""))).alias("project"), model_name(F.col("model")).alias("raw_model"), u("input").alias("input_tokens"),
        u("output").alias("output_tokens"), u("cacheRead").alias("cache_read_tokens"), u("cacheWrite").alias("cache_write_tokens"), F.least(u("reasoning"), u("output")).alias("reasoning_tokens"),
        F.least(u("cacheWrite1h"), u("cacheWrite")).alias("cache_write_1h_tokens"), text("r.id").alias("native_id"), ordinal_text("value").alias("ordinal"), F.lit("").alias("service_tier"),
    )
    own = F.concat(F.lit("pi:"), "session_id", F.lit(":"), "native_id")
    return _finish(out.withColumn("id", F.coalesce(own, fallback_id("pi", F.col("session_id"), F.col("ms"), F.col("ordinal"), F.col("line")))), "pi").where(TOTAL)


def pi_files(lines: DataFrame) -> DataFrame:
    """(session_id, parent_id, forked_ms) of each file's last header."""
    rows = _pi_rows(lines).groupBy("file").agg(F.max_by(F.struct("session", "parent", "forked"), "line").alias("h"))
    return rows.select(F.coalesce("h.session", file_session()).alias("session_id"), F.nullif("h.parent", F.lit("")).alias("parent_id"), F.nullif("h.forked", F.lit(0)).cast("long").alias("forked_ms"))


_GROK_ROW = "inputTokens: DOUBLE, outputTokens: DOUBLE, cachedReadTokens: DOUBLE, cacheCreationTokens: DOUBLE, reasoningTokens: DOUBLE, modelCalls: DOUBLE, costUsdTicks: DOUBLE, costIsPartial: STRING, usageIsIncomplete: STRING"
_GROK_USAGE = f"{_GROK_ROW}, primaryModelId: STRING, modelUsage: MAP<STRING, STRUCT<{_GROK_ROW}>>"
#: The largest whole number that a double holds exactly.
SAFE = (1 << 53) - 1


def encoded(value: Column) -> Column:
    """The text as a part of an address; letters, digits and -_.!~*'() stay."""
    out = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    for sign, code in (("!", "%21"), ("~", "%7E"), ("'", "%27"), ("(", "%28"), (")", "%29")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def _grok_calls(turns: DataFrame) -> DataFrame:
    """turns (file, session_id, project, model, turn, ms, u) to candidates: a row for each model, or one for the turn."""
    row = lambda name: F.struct(*[F.col(f"u.{f.split(':')[0]}").alias(f.split(":")[0]) for f in _GROK_ROW.split(", ")])
    whole = F.array(F.struct(F.coalesce(text("u.primaryModelId"), F.nullif("model", F.lit("")), F.lit("unknown")).alias("key"), row("u").alias("value")))
    rows = turns.withColumn("m", F.explode(F.when(F.size(F.coalesce(F.map_keys("u.modelUsage"), F.array())) > 0, F.map_entries("u.modelUsage")).otherwise(whole)))
    count = lambda c: (F.col(f"m.value.{c}") >= 0) & (F.col(f"m.value.{c}") <= SAFE) & (F.floor(f"m.value.{c}") == F.col(f"m.value.{c}"))
    valid = F.coalesce(count("inputTokens") & count("outputTokens"), F.lit(False))
    for c in ("cachedReadTokens", "cacheCreationTokens", "reasoningTokens", "modelCalls"):
        valid = valid & F.coalesce(count(c), F.lit(True))
    said = lambda c: F.coalesce(F.col(c), F.lit("false")) != "false"
    partial = said("m.value.costIsPartial") | said("m.value.usageIsIncomplete") | said("u.usageIsIncomplete")
    model = F.coalesce(F.nullif("m.key", F.lit("")), F.lit("unknown"))
    n = lambda c: number(f"m.value.{c}")
    out = rows.where(valid).select(
        "file", F.col("turn").alias("line"), "ms", "session_id", "project", model.alias("raw_model"), F.concat(F.lit("grok:turn:"), encoded(F.col("session_id")), F.lit(":"), F.col("turn").cast("string"), F.lit(":"), encoded(model)).alias("id"),
        *_split_cache(n("inputTokens"), n("cachedReadTokens"), n("cacheCreationTokens"), n("outputTokens"), n("reasoningTokens")),
        F.when(~partial & count("costUsdTicks") & (F.col("m.value.costUsdTicks") > 0), F.col("m.value.costUsdTicks") / 1e10).alias("reported_cost_usd"), F.col("m.value.modelCalls").cast("int").alias("requests"), F.lit("").alias("service_tier"),
    )
    return _finish(out, "grok").where("input_tokens + cache_read_tokens + cache_write_tokens + output_tokens > 0")


def grok(ledgers: DataFrame) -> DataFrame:
    """Ledgers (file, session_id, project, model, value): a row for each turn and model. Positive complete costs are
    kept, in ticks of 1e-10 dollars. A ledger of another session, or without turns, has no rows."""
    schema = f"sessionId STRING, turns ARRAY<STRUCT<turnNumber: DOUBLE, endedAt: STRING, {_GROK_USAGE}>>"
    rows = ledgers.withColumn("l", F.from_json("value", schema)).where(text("l.sessionId").isNull() | (text("l.sessionId") == F.col("session_id")))
    turns = rows.select("file", "session_id", "project", "model", F.explode("l.turns").alias("u")).withColumns({"turn": number("u.turnNumber"), "ms": log_millis(F.col("u.endedAt"))})
    return _grok_calls(turns.where("turn > 0 AND ms IS NOT NULL"))


def grok_updates(lines: DataFrame) -> DataFrame:
    """Update streams (file, session_id, project, model, line, value): the user's turns in order; the last completion of
    one event replaces the turn, and the model that updates name carries forward."""
    schema = f"""timestamp STRING, params STRUCT<_meta: STRUCT<eventId: STRING, agentTimestampMs: STRING>,
    update: STRUCT<sessionUpdate: STRING, _meta: STRUCT<modelId: STRING>, usage: STRUCT<{_GROK_USAGE}>>>"""
    rows = lines.withColumn("r", F.from_json("value", schema)).where("r IS NOT NULL").withColumn("named", text("r.params.update._meta.modelId"))
    rows = carried_over(rows, {"named": F.col("named")}, ["file"], ["line"]).withColumn("model", F.coalesce("named", "model")).where("r.params.update.sessionUpdate = 'turn_completed'")
    event = F.coalesce(text("r.params._meta.eventId"), F.concat(F.lit("\x00"), F.col("line").cast("string")))
    rows = rows.withColumn("event", event)
    turns = numbered(rows.groupBy("file", "event").agg(F.min("line").alias("first")), ["file"], "first", "turn")
    rows = rows.join(turns, ["file", "event"])
    ms = F.coalesce(log_millis(F.col("r.params._meta.agentTimestampMs")), log_millis(F.col("r.timestamp")))
    rows = rows.select("file", "session_id", "project", "model", "turn", "line", ms.alias("ms"), F.col("r.params.update.usage").alias("u")).where("u IS NOT NULL AND ms IS NOT NULL")
    last = Window.partitionBy("file", "turn").orderBy(F.desc("line"))
    return _grok_calls(rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "line"))


def grok_sessions(ledgers: DataFrame, updates: DataFrame) -> DataFrame:
    """Candidates of sessions by their ledger, and by their updates where the ledger is missing or gives nothing."""
    own = grok(ledgers)
    return own.unionByName(grok_updates(updates).join(own.select("session_id").distinct(), "session_id", "left_anti"))


MUSE = """id STRING, payload_type STRING, recorded_at STRING, sequence DOUBLE, stream STRUCT<kind: STRING, id: STRING>, payload STRUCT<source_run_record_id: STRING, record: STRUCT<workspace_root: STRING, model_id: STRING>,
event: STRUCT<kind: STRING, model: STRING, usage: STRUCT<input_tokens: DOUBLE, cache_read_tokens: DOUBLE, cached_tokens: DOUBLE, cache_write_tokens: DOUBLE, output_tokens: DOUBLE, reasoning_tokens: DOUBLE>>>"""


def _muse_records(lines: DataFrame) -> DataFrame:
    """(file, line, value, place, ordinal): records that frames nest as JSON text, unfolded until a level is empty; place
    orders a line's records. Each level is a table, so that none is unfolded twice."""
    level = once(lines.select("file", "line", "value"), "value", F.col("value")).select("file", "line", "value", F.array().cast("array<int>").alias("place"), F.lit("").alias("ordinal"))
    every = None
    while True:
        level = once(level, "children", F.get_json_object("value", "$.children"))
        frame, single = F.coalesce(F.col("children").startswith("["), F.lit(False)), level.columns[:-1]
        plain = level.where(~frame).select(*single)
        every = plain if every is None else every.union(plain)
        children = F.from_json("children", "array<struct<record_json:string,child_index:long>>")
        inner = level.where(frame).select("file", "line", "place", "ordinal", F.posexplode(children).alias("at", "c")).where("trim(c.record_json) <> ''")
        level = written(inner.select("file", "line", F.col("c.record_json").alias("value"), F.concat("place", F.array("at")).alias("place"), F.concat_ws(":", F.nullif("ordinal", F.lit("")), F.coalesce("c.child_index", "at").cast("string")).alias("ordinal")), "muse")
        if level.isEmpty():
            return every


def muse_path_ids(file: str = "file") -> tuple[Column, Column]:
    """Session and parent of a path: .../<session>/session.jsonl, or .../<parent>/<group>/<session>/session.jsonl."""
    parts = F.filter(F.split(file, r"[\\/]"), lambda x: x != "")
    at = lambda n: F.try_element_at(parts, F.lit(n))
    groups = ("subagent", "approval-review", "workflows")
    session = F.when(file_session(file) == "session", F.coalesce(at(-2), F.lit("unknown"))).otherwise(file_session(file))
    parent = F.when(at(-3).isin(*groups), at(-4)).when(at(-2).isin(*groups), at(-3))
    return session, F.when(parent != session, parent)


def muse(lines: DataFrame) -> DataFrame:
    """model_completed events of session streams; session, workspace and model of earlier records carry forward."""
    of_path, parent = muse_path_ids()
    rows = parsed_records(_muse_records(lines), MUSE).where("coalesce(trim(r.stream.kind), '') IN ('', 'session')")
    told = F.col("r.payload_type").isin("runtime.session.metadata", "session.workspace_branch.observed", "run.model.configured")
    rows = rows.withColumns({"told": F.coalesce(told, F.lit(False)), "stream": F.when(F.col("r.stream.kind") == "session", text("r.stream.id"))})
    rows = rows.withColumns({"directory": F.when(F.col("told"), text("r.payload.record.workspace_root")), "model": F.when(F.col("told"), text("r.payload.record.model_id"))})
    rows = carried_over(rows, {c: F.col(c) for c in ("stream", "directory", "model")}, ["file"], ["line", "place"])
    calls = rows.where("r.payload.event.kind = 'model_completed' AND r.payload.event.usage IS NOT NULL AND NOT told")
    at = F.col("r.recorded_at").try_cast("double")
    ms = F.when(at.isNull(), log_millis(F.col("r.recorded_at"))).when(at > 1e17, at / 1e6).when(at > 1e14, at / 1e3).when(at > 1e11, at).otherwise(at * 1000).cast("long")
    calls = calls.withColumns({"ms": F.when(ms > 0, ms), "session_id": F.coalesce("stream", of_path)})
    native = F.coalesce(text("r.payload.source_run_record_id"), text("r.id"))
    ordinal = F.coalesce(ordinal_text("value", "$.sequence"), F.when(F.col("ordinal") != "", quoted(F.concat_ws(":", F.col("line").cast("string"), "ordinal"))))
    u = lambda n: number(f"r.payload.event.usage.{n}")
    out = calls.select(
        "file", "line", "ms", "session_id", project_name(F.col("directory")).alias("project"), parent.alias("parent_id"), model_name(F.coalesce(text("r.payload.event.model"), "model")).alias("raw_model"), F.lit("").alias("service_tier"),
        F.coalesce(F.concat(F.lit("muse:record:"), native), fallback_id("muse", F.col("session_id"), F.col("ms"), ordinal, F.col("line"))).alias("id"),
        *_split_cache(u("input_tokens"), F.greatest(u("cache_read_tokens"), u("cached_tokens")), u("cache_write_tokens"), u("output_tokens"), u("reasoning_tokens")),
    )
    return _finish(out, "muse").where(TOTAL)


def parsed_records(rows: DataFrame, schema: str) -> DataFrame:
    return once(rows, "r", F.from_json("value", schema)).where("r IS NOT NULL")


def as_events(candidates: DataFrame, device_id: str) -> DataFrame:
    """Candidates of a collection as rows of the fact table. A cost that the log reports whole is known."""
    known = F.col("reported_cost_usd").isNotNull()
    return candidates.select(
        "*", F.lit(device_id).alias("device_id"), F.to_timestamp_ntz(F.regexp_replace(utc_iso(F.col("ms")), "Z$", "")).alias("ts"), F.coalesce("reported_cost_usd", F.lit(0.0)).alias("cost_usd"), known.alias("cost_known"),
        *[F.lit(None).cast("string").alias(c) for c in ("repository", "session_title", "project_name", "thread_id", "thread_url")],
    ).drop("sidechain", "native_id", "parent_id", "legacy_id", "file", "line")
