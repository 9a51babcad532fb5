"""A collection: what readers found, without replays and copies, with metadata, and what is to be withdrawn."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metergrid.operators import dedupe
from metergrid.sources import logs
from metergrid.tables import written


@dataclass(frozen=True)
class Collection:
    """events: one candidate for each call. withdrawn (id): what earlier collections may have uploaded and these logs
    disown."""

    events: DataFrame
    withdrawn: DataFrame


def collected(candidates: DataFrame, withdrawn: DataFrame) -> Collection:
    """One row a call, and the withdrawn ids that no row has. The candidates have the ids of the rows, so that copies needn't
    be removed for the second."""
    return Collection(dedupe.collector_dedup(candidates), dedupe.retracted(withdrawn, candidates))


def claude_collection(lines: DataFrame) -> Collection:
    """Sidechain rows that replay one billed original are dropped, and withdrawn unless they are that original. Advisors'
    former ids are withdrawn."""
    calls = written(logs.claude_calls(lines), "claude")
    rows, empty = calls.where(logs.TOTAL), written(logs.claude_empty(lines, calls), "claude-empty")
    kept = dedupe.without_replays(rows, empty)
    gone = dedupe.replayed(rows, empty).union(kept.where("legacy_id IS NOT NULL").select("legacy_id"))
    return collected(kept, gone)


def codex_collection(lines: DataFrame) -> Collection:
    """Running totals that a session copied from its parent are dropped."""
    rows, withdrawn = logs.codex(lines)
    files = logs.codex_files(lines).groupBy("session_id").agg(F.min_by("parent_id", "file").alias("parent_id"), F.min_by("forked_ms", "file").alias("forked_ms"))
    return collected(dedupe.without_parent_records(rows, files), withdrawn.select("id"))


def pi_collection(lines: DataFrame) -> Collection:
    """Rows of copied branches go to the session that they came from."""
    rows = dedupe.original_owners(logs.pi(lines), logs.pi_files(lines))
    return collected(rows, rows.where("withdrawn IS NOT NULL").select(F.col("withdrawn").alias("id")))


def muse_collection(lines: DataFrame) -> Collection:
    """Sessions without a workspace have that of the session around them."""
    session, parent = logs.muse_path_ids()
    files = lines.select("file").distinct().select(session.alias("session_id"), parent.alias("parent_id"))
    rows = dedupe.parent_projects(logs.muse(lines), files, logs.UNKNOWN_PROJECT)
    return collected(rows, rows.select("id").limit(0))


def with_metadata(events: DataFrame, threads: DataFrame, repositories: DataFrame) -> DataFrame:
    """Adds what other sources know: threads (harness, session_id, session_title, project_name, thread_id, thread_url,
    project, priority), of which a session takes the first, and repositories (project, repository). The event's own
    directory wins over the thread's where both have a repository that isn't local."""
    from pyspark.sql import Window

    first = Window.partitionBy("harness", "session_id").orderBy("priority", "thread_id")
    one = threads.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "priority").withColumnRenamed("project", "_attached")
    own = repositories.select("project", F.col("repository").alias("_own"))
    attached = repositories.select(F.col("project").alias("_attached"), F.col("repository").alias("_other"))
    rows = events.join(one, ["harness", "session_id"], "left").join(own, "project", "left").join(attached, "_attached", "left")
    remote = lambda c: F.when(~F.col(c).startswith("local:"), F.col(c))
    return rows.withColumn("repository", F.coalesce(remote("_own"), remote("_other"), "_own", "_other")).drop("_own", "_other", "_attached")
