"""Titles, projects and links of sessions from the tables of a thread database.

The tables come as DataFrames with a column `db`, the place of their database among those read (from 0). Threads of the
current layout win over those of the older one, earlier databases over later ones.
"""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metergrid.sources.logs import encoded

# Drivers and their harnesses, and the longest JSON text that is read.
DRIVERS = {"claudeAgent": "claude", "claude": "claude", "codex": "codex", "grok": "grok", "pi": "pi", "muse": "muse", "antigravity": "antigravity"}
MOST_JSON = 262_144
#: Places of the layouts within a database.
CURRENT, RUNTIME, SESSIONS = 0, 1, 2


def short_text(value: Column, most: int = 1024) -> Column:
    """The trimmed text; null if nothing is left or the text is longer than `most`."""
    return F.when(F.char_length(value) <= most, F.nullif(F.regexp_replace(value, r"^\s+|\s+$", ""), F.lit("")))


def _bindings(rows: DataFrame, projects: DataFrame, layer: int, newest: Column) -> DataFrame:
    """One form for the three tables that tie a native session to a thread."""
    named = projects.select("db", "project_id", F.col("title").alias("project_name"), "workspace_root")
    drivers = F.create_map(*[F.lit(x) for pair in DRIVERS.items() for x in pair])
    return rows.join(named, ["db", "project_id"], "left").select(
        drivers[F.col("driver")].alias("harness"), short_text(F.col("native"), 512).alias("session_id"), short_text(F.col("thread_id"), 512).alias("thread_id"),
        short_text(F.col("title")).alias("session_title"), F.nullif(short_text(F.col("project_name")), F.lit("No project")).alias("project_name"),
        short_text(F.col("worktree"), 4096).alias("worktree"), short_text(F.col("workspace_root"), 4096).alias("root"),
        F.col("deleted_at").isNotNull().alias("deleted"), (F.col("db") * 3 + layer).alias("place"), newest.cast("double").alias("newest"),
    ).where("harness IS NOT NULL AND session_id IS NOT NULL AND thread_id IS NOT NULL")


def current_bindings(provider_threads: DataFrame, threads: DataFrame, projects: DataFrame) -> DataFrame:
    """provider_threads (db, thread_id, payload_json, updated_at), threads (db, thread_id, project_id, title,
    payload_json, deleted_at), projects (db, project_id, title, workspace_root). Payloads that are too long or no JSON
    bind nothing."""
    payload = F.when(F.char_length("payload_json") <= MOST_JSON, F.col("payload_json"))
    native = provider_threads.select(
        "db", "thread_id", "updated_at", F.get_json_object(payload, "$.nativeThreadRef.nativeId").alias("native"), F.get_json_object(payload, "$.nativeThreadRef.driver").alias("driver")
    ).where("native IS NOT NULL")
    own = threads.select("db", "thread_id", "project_id", "title", "deleted_at", F.get_json_object(payload, "$.worktreePath").alias("worktree"))
    return _bindings(native.join(own, ["db", "thread_id"]), projects, CURRENT, F.col("updated_at"))


def older_bindings(runtime: DataFrame, sessions: DataFrame, threads: DataFrame, projects: DataFrame) -> DataFrame:
    """runtime (db, thread_id, provider_name, resume_cursor_json), sessions (db, thread_id, provider_name,
    provider_thread_id, provider_session_id), threads (db, thread_id, project_id, title, worktree_path, deleted_at)."""
    own = threads.withColumnRenamed("worktree_path", "worktree")
    cursor = [F.get_json_object("resume_cursor_json", x) for x in ("$.threadId", "$.sessionId")]
    one = runtime.select("db", "thread_id", F.coalesce(*cursor).alias("native"), F.col("provider_name").alias("driver"))
    two = sessions.select("db", "thread_id", F.coalesce("provider_thread_id", "provider_session_id").alias("native"), F.col("provider_name").alias("driver"))
    return _bindings(one.join(own, ["db", "thread_id"]), projects, RUNTIME, F.lit(None)).unionByName(_bindings(two.join(own, ["db", "thread_id"]), projects, SESSIONS, F.lit(None)))


def thread_url(base: str, environment: str | None, thread: Column) -> Column:
    """The web address of a thread; null without an environment or where base is no plain web address."""
    parts = urlsplit(base)
    if not environment or parts.scheme not in ("http", "https") or not parts.hostname or parts.username or parts.password or parts.query or parts.fragment:
        return F.lit(None).cast("string")
    return F.concat(F.lit(f"{parts.scheme}://{parts.netloc.lower()}{parts.path.rstrip('/')}/"), encoded(F.lit(environment)), F.lit("/"), encoded(thread))


def thread_metadata(bindings: DataFrame, current_threads: DataFrame, base: str, environment: str | None) -> DataFrame:
    """(harness, session_id, thread_id, session_title, project_name, thread_url, repository_paths, project, priority)
    of each native session: its first binding. A binding whose thread an earlier or the same place marks as deleted
    keeps the thread's id, an empty link and nothing else, so that a link stored before is cleared. `project` is the
    first path; the table is what collect.with_metadata() joins.

    Of bindings of one place the newest wins, then the smaller thread id.
    """
    marks = current_threads.where("deleted_at IS NOT NULL").select(short_text(F.col("thread_id"), 512).alias("thread_id"), (F.col("db") * 3).alias("place"))
    gone = marks.unionByName(bindings.where("deleted").select("thread_id", "place")).groupBy("thread_id").agg(F.min("place").alias("gone_at"))
    first = Window.partitionBy("harness", "session_id").orderBy("place", F.col("newest").desc_nulls_last(), "thread_id")
    one = bindings.withColumn("n", F.row_number().over(first)).where("n = 1").join(gone, "thread_id", "left")
    dead = F.coalesce(F.col("gone_at") <= F.col("place"), F.lit(False))
    alive = lambda c: F.when(~dead, c)
    paths = F.array_distinct(F.array_compact(F.array("worktree", "root")))
    return one.select(
        "harness", "session_id", "thread_id", alive(F.col("session_title")).alias("session_title"), alive(F.col("project_name")).alias("project_name"),
        F.when(dead, F.lit("")).otherwise(thread_url(base, environment, F.col("thread_id"))).alias("thread_url"),
        F.when(dead, F.array().cast("array<string>")).otherwise(paths).alias("repository_paths"), alive(F.coalesce("worktree", "root")).alias("project"), F.lit(0).alias("priority"),
    )
