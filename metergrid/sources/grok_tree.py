"""Grok sessions as a tree: projects, sub-agents and their roots, ledgers that are abandoned, and owners of forked turns.

Tables: sessions (session_id, parent_id, forked_ms, kind, folder, cwd_file, cwd, model, has_log), one row each; links
(child_id, parent_id, seq) from the folders of sub-agents; rows (session_id, turn, raw_model, ms, id, sidechain, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metergrid.sources import logs
from metergrid.sources.threads import encoded
from metergrid.tables import Scratch

SUBAGENT = "subagent"
#: Turns of a copy may differ from the original's time by this much.
NEAR_MS = 2
#: Width of the slots by which times are matched: so wide that few turns lie near an edge.
SLOT_MS = 64


def session_projects(sessions: DataFrame) -> DataFrame:
    """sessions with project: the directory that the summary names, else the path that the name of the folder above encodes,
    else what that folder's .cwd file holds, else unknown."""
    decoded = F.try_url_decode(F.try_element_at(F.split("folder", "/"), F.lit(-2)))
    group = F.coalesce(F.when(decoded.startswith("/"), decoded), F.nullif(F.regexp_replace("cwd_file", r"^\s+|\s+$", ""), F.lit("")))
    return sessions.withColumn("project", F.coalesce(logs.text("cwd"), group, F.lit(logs.UNKNOWN_PROJECT)))


def subagents(sessions: DataFrame, links: DataFrame) -> DataFrame:
    """(session_id, up): sub-agents by kind or by a link, and whose they are: by the last link, else by their own record."""
    linked = links.where("child_id <> '' AND child_id <> parent_id").groupBy(F.col("child_id").alias("session_id")).agg(F.max_by("parent_id", "seq").alias("linked"))
    every = sessions.select("session_id", "parent_id", "kind").join(linked, "session_id", "left")
    return every.where(F.col("linked").isNotNull() | F.coalesce(F.col("kind"), F.lit("")).startswith(SUBAGENT)).select("session_id", F.nullif(F.coalesce("linked", "parent_id"), F.lit("")).alias("up"))


def roots(sessions: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(session_id, root) of each sub-agent: the first session above that is none. root is null where the way up ends at a
    session that isn't there, or in a circle.

    Pointers double in each round, which resolves everything up to twice as far; what no round resolves lies on a way into
    a circle, and the rounds end once one resolves nothing. Each round is a table."""
    there = sessions.select(F.col("session_id").alias("up"), F.lit(True).alias("there"))
    below = subagents(sessions, links)
    inner = below.select(F.col("session_id").alias("up"), F.lit(True).alias("inner"))
    step = below.join(there, "up", "left").join(inner, "up", "left")
    # up: where to go on; root: where it ended; done once either is settled
    step = step.select("session_id", F.when(F.col("there"), F.col("up")).alias("up"), (F.col("there").isNull() | F.col("inner").isNull()).alias("done"))
    now = scratch.written(step, "roots")
    left = now.where("NOT done").count()
    while left:
        on = now.select(F.col("session_id").alias("up"), F.col("up").alias("next"), F.col("done").alias("next_done"))
        moved = now.where("NOT done").join(on, "up").select("session_id", F.col("next").alias("up"), F.col("next_done").alias("done"))
        following = scratch.written(now.where("done").unionByName(moved), "roots")
        scratch.drop(now)
        now, before = following, left
        left = now.where("NOT done").count()
        if left == before:
            break
    return now.select("session_id", F.when(F.col("done"), F.col("up")).alias("root"))


def orphans(sessions: DataFrame, links: DataFrame, parsed: DataFrame, scratch: Scratch) -> DataFrame:
    """Sub-agents whose root isn't there or has no accounting that could be read. parsed: (session_id)."""
    read = parsed.select(F.col("session_id").alias("root")).distinct()
    return roots(sessions, links, scratch).join(read, "root", "left_anti").select("session_id")


def malformed_ledgers(ledgers: DataFrame) -> DataFrame:
    """(session_id, malformed) of each ledger (file, session_id, project, model, value): parts that can't be read. A ledger
    that is no object with turns, or is another session's, is one such part."""
    schema = f"sessionId STRING, turns ARRAY<STRUCT<turnNumber: DOUBLE, endedAt: STRING, {logs._GROK_USAGE}>>"
    rows = ledgers.select("file", "session_id", F.from_json("value", schema).alias("l"), F.try_variant_get(F.try_parse_json("value"), "$.turns[0]", "variant").alias("first"))
    whole = F.col("l.turns").isNotNull() & F.coalesce(logs.text("l.sessionId") == F.col("session_id"), F.lit(True))
    row = lambda at: F.struct(*[at[f.split(":")[0]].alias(f.split(":")[0]) for f in logs._GROK_ROW.split(", ")])

    def bad_row(r: Column) -> Column:
        n = lambda c: (r[c] >= 0) & (r[c] <= logs.SAFE) & (F.floor(r[c]) == r[c])
        bad = ~F.coalesce(n("inputTokens") & n("outputTokens"), F.lit(False))
        for c in ("cachedReadTokens", "cacheCreationTokens", "reasoningTokens", "modelCalls"):
            bad = bad | ~F.coalesce(n(c), F.lit(True))
        return bad

    def bad_parts(t: Column) -> Column:
        stamp = logs.log_millis(t["endedAt"])
        values = F.coalesce(F.map_values(t["modelUsage"]), F.array())
        several = F.size(F.filter(values, lambda r: bad_row(r)))
        one = F.when(bad_row(row(t)), 1).otherwise(0)
        return F.when(t.isNull() | (logs.number(t["turnNumber"]) == 0) | stamp.isNull() | (stamp <= 0), 1).when(F.size(values) > 0, several).otherwise(one)

    total = F.aggregate(F.transform("l.turns", bad_parts), F.lit(0), lambda a, x: a + x)
    return rows.select("session_id", F.when(whole, total).otherwise(1).cast("long").alias("malformed"))


def session_rows(sessions: DataFrame, links: DataFrame, ledgers: DataFrame, updates: DataFrame, malformed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, problems). A session's rows are its ledger's; if the ledger is missing, or any part of it is malformed, its
    updates' where there are any. Sub-agents have no rows: their parents' turns hold their usage. problems: (session_id,
    malformed) of the sessions with rows of a ledger that nothing replaces, or of one that was abandoned."""
    own = sessions.select("session_id").join(subagents(sessions, links), "session_id", "left_anti")
    bad = malformed_ledgers(ledgers) if malformed is None else malformed
    lines = updates.join(own, "session_id", "left_semi")
    has_updates = lines.select("session_id").distinct()
    sound = ledgers.select("session_id").join(bad.where("malformed > 0").select("session_id"), "session_id", "left_anti")
    ledger_only = ledgers.select("session_id").join(has_updates, "session_id", "left_anti")
    by_ledger = sound.union(ledger_only).distinct().join(own, "session_id", "left_semi")
    first = logs.grok(ledgers.join(by_ledger, "session_id", "left_semi"))
    second = logs.grok_updates(lines.join(by_ledger, "session_id", "left_anti"))
    return first.unionByName(second), bad.where("malformed > 0").join(own, "session_id", "left_semi")


def fork_owners(rows: DataFrame, sessions: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of forked sessions under the session that owns them. A turn of a copy belongs to the parent while the parent has
    the same turn and model at most NEAR_MS apart, or the turn is older than the copy, or the parent is gone and the turn
    was made as the copy was; and so on from owner to owner. `id` follows the owner, and rows that moved yield to the
    owner's own (sidechain).

    A round moves every turn that can move by one session, so there are as many rounds as the longest chain of forks that
    a turn goes up; a turn that stops takes part in no further round. The rows and the turns to compare with are tables, which each
    round reads. Times are matched by equal slots, of which a turn near an edge has both, and then exactly."""
    slot = lambda ms: F.floor(ms / SLOT_MS)
    rows = scratch.written(rows, "fork-rows")
    edges = F.array_distinct(F.array(slot(F.col("ms") - NEAR_MS), slot(F.col("ms") + NEAR_MS)))
    turns = rows.select(F.col("session_id").alias("parent_id"), "turn", "raw_model", F.col("ms").alias("at")).distinct().withColumn("ms", F.col("at")).withColumn("slot", F.explode(edges)).drop("ms")
    turns = scratch.written(turns, "fork-turns")
    ups = sessions.select(F.col("session_id").alias("owner"), F.nullif("parent_id", F.lit("")).alias("parent_id"), "forked_ms")
    there = sessions.select(F.col("session_id").alias("parent_id"), F.lit(True).alias("there"))
    of = ups.join(there, "parent_id", "left").where("parent_id IS NOT NULL")
    key = ["session_id", "turn", "raw_model", "ms"]
    walking = rows.select(*key).distinct().withColumn("owner", F.col("session_id")).withColumn("seen", F.array().cast("array<string>"))
    moved: list[DataFrame] = []
    while True:
        tried = walking.where(~F.array_contains("seen", F.col("owner"))).join(of, "owner")
        tried = tried.select(*key, "seen", "owner", "parent_id", F.expr("coalesce(ms < forked_ms, false) OR (there IS NULL AND coalesce(ms = forked_ms, false))").alias("moves"), slot(F.col("ms")).alias("slot"))
        step = rows.sparkSession.sql(
            """SELECT * FROM {tried} AS w WHERE w.moves OR EXISTS (SELECT 1 FROM {turns} AS t WHERE t.parent_id = w.parent_id AND t.turn = w.turn AND t.raw_model = w.raw_model AND t.slot = w.slot
            AND abs(w.ms - t.at) <= {most})""", tried=tried, turns=turns, most=NEAR_MS,
        )
        on = scratch.written(step.select(*key, F.col("parent_id").alias("owner"), F.array_append("seen", F.col("owner")).alias("seen")), "forks")
        if on.isEmpty():
            break
        moved.append(on)
        walking = on
    if not moved:
        return rows
    last = moved[0]
    for on in moved[1:]:
        last = last.unionByName(on)
    owners = last.groupBy(*key).agg(F.max_by("owner", F.size("seen")).alias("owner"))
    found = rows.join(owners, key, "left").withColumn("_own", F.col("session_id")).withColumn("session_id", F.coalesce("owner", "session_id"))
    turn_id = F.concat(F.lit("grok:turn:"), encoded(F.col("session_id")), F.lit(":"), F.col("turn").cast("string"), F.lit(":"), encoded(F.col("raw_model")))
    return found.withColumns({"id": F.when(F.col("owner").isNotNull(), turn_id).otherwise(F.col("id")), "sidechain": F.col("session_id") != F.col("_own")}).drop("owner", "_own")
