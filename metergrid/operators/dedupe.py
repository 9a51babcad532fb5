"""One row for each call: copies between devices, within a collection, replays and forks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metergrid.functions.expr import device, token_total
from metergrid.tables import written


def _first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    # row_number() = 1 lets Spark cut each partition to one row a key before the shuffle
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def owner_dedup(events: DataFrame, local_device: str) -> DataFrame:
    """The copy with most tokens of each (harness, id); of equal ones the local device's, else the smallest device's.
    The winner keeps its own time, project and device, so windows are applied afterwards."""
    return _first(events, ["harness", "id"], token_total().desc(), (device() != local_device).asc(), device().asc())


#: Ids that a semi join may broadcast.
BROADCAST_IDS = 200_000


def window_owners(events: DataFrame, inside: Column, local_device: str) -> DataFrame:
    """owner_dedup() of the events inside a window: only ids that occur there are deduplicated, with their copies outside.
    A copy outside can own a call, which is then not in the window. The ids are broadcast if they are few."""
    ids = events.where(inside).select("harness", "id").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    candidates = events.join(F.broadcast(ids) if few else ids, ["harness", "id"], "left_semi")
    return owner_dedup(candidates, local_device).where(inside)


def collector_dedup(candidates: DataFrame) -> DataFrame:
    """Within one collection: a main row beats a sidechain's, then more tokens, then the first seen (file, line)."""
    return _first(candidates, ["id"], F.coalesce("sidechain", F.lit(False)).asc(), token_total().desc(), F.col("file").asc(), F.col("line").asc())


def divergent_copies(events: DataFrame) -> DataFrame:
    """(harness, id, copies) of calls whose copies have different times."""
    return events.groupBy("harness", "id").agg(F.count("*").alias("copies"), F.count_distinct("ms").alias("times")).where("times > 1").drop("times")


def _replays(candidates: DataFrame, empty: DataFrame | None) -> DataFrame:
    """candidates with `replay`: sidechain rows whose (native_id, session_id) belongs to exactly one original identity
    that was billed; and `same`, whether that identity is the row's own. Originals are main rows (an extra call counts
    as its parent) and empty requests (native_id, session_id, id), which bill nothing."""
    key = ["native_id", "session_id"]
    main = candidates.where("NOT sidechain AND native_id IS NOT NULL").select(*key, F.coalesce("parent_id", "id").alias("owner"), (token_total() > 0).alias("billed"))
    if empty is not None:
        main = main.union(empty.select(*key, F.col("id").alias("owner"), F.lit(False).alias("billed")))
    owners = main.groupBy(*key).agg(F.min("owner").alias("owner"), F.count_distinct("owner").alias("owners"), F.bool_or("billed").alias("billed")).where("owners = 1 AND billed").select(*key, "owner")
    joined = candidates.join(owners, key, "left").withColumn("replay", F.col("sidechain") & F.col("native_id").isNotNull() & F.col("owner").isNotNull())
    return joined.withColumn("same", F.col("owner").eqNullSafe(F.coalesce("parent_id", "id"))).drop("owner")


def without_replays(candidates: DataFrame, empty: DataFrame | None = None) -> DataFrame:
    """Without the sidechain rows that replay one original request."""
    return _replays(candidates, empty).where("NOT replay").drop("replay", "same")


def replayed(candidates: DataFrame, empty: DataFrame | None = None) -> DataFrame:
    """(id): rows that without_replays() drops, and that are to be withdrawn, since they aren't their original."""
    return _replays(candidates, empty).where("replay AND NOT same").select("id").distinct()


def ancestors(files: DataFrame, depth: int = 32) -> DataFrame:
    """(session_id, ancestor, distance) along parents, cycles cut: joins of doubling reach. The first log2(depth) of them
    are one plan; longer chains get further ones, each written to a table, until one adds no row."""
    step = files.where("parent_id IS NOT NULL AND parent_id <> session_id").select("session_id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("distance")).distinct()
    reach, found, rows = 1, step, -1
    while True:
        if reach >= depth:
            found = written(found, "ancestors")
            before, rows = rows, found.count()
            if rows == before:
                return found
        further = found.alias("a").join(found.alias("b"), F.col("a.ancestor") == F.col("b.session_id")).select(
            F.col("a.session_id").alias("session_id"), F.col("b.ancestor").alias("ancestor"), (F.col("a.distance") + F.col("b.distance")).alias("distance")
        )
        found = found.union(further.where("ancestor <> session_id")).groupBy("session_id", "ancestor").agg(F.min("distance").alias("distance"))
        reach *= 2


def inherited_project(files: DataFrame, depth: int = 32) -> DataFrame:
    """(session_id, project): a session's own project, or that of its nearest ancestor with one."""
    owned = files.where("project IS NOT NULL").select(F.col("session_id").alias("ancestor"), F.col("project").alias("held"))
    near = ancestors(files, depth).join(owned, "ancestor").groupBy("session_id").agg(F.min_by("held", "distance").alias("held"))
    return files.join(near, "session_id", "left").select("session_id", F.coalesce("project", "held").alias("project"))


def fork_owner(rows: DataFrame, files: DataFrame, depth: int = 32) -> DataFrame:
    """rows (session_id, native_id, ms, ...) with owner: the most distant ancestor session that holds the same
    native_id, for rows from before the session's fork; else the session itself."""
    held = rows.select(F.col("session_id").alias("ancestor"), "native_id").distinct()
    up = ancestors(files, depth).join(held, "ancestor").groupBy("session_id", "native_id").agg(F.max_by("ancestor", "distance").alias("first"))
    forked = files.select("session_id", "forked_ms")
    joined = rows.join(up, ["session_id", "native_id"], "left").join(forked, "session_id", "left")
    inherited = F.col("first").isNotNull() & (F.col("forked_ms").isNull() | (F.col("ms") <= F.col("forked_ms")))
    return joined.withColumn("owner", F.when(inherited, F.col("first")).otherwise(F.col("session_id"))).drop("first", "forked_ms")


def without_parent_records(rows: DataFrame, files: DataFrame, depth: int = 32, compactions: DataFrame | None = None) -> DataFrame:
    """Rows of forked sessions (files: session_id, parent_id, forked_ms) without copies: rows from before the fork, responses
    that the session and its parent both list as compactions (session_id, response), and running totals whose time and
    counters the parent has too. Parents are filtered before their children, so where a chain of sessions holds a row,
    every second one of them keeps it."""
    if compactions is not None:
        up = files.where("parent_id <> session_id").select("session_id", "parent_id")
        above = compactions.select(F.col("session_id").alias("parent_id"), "response").distinct()
        both = compactions.join(up, "session_id").join(above, ["parent_id", "response"], "left_semi")
        rows = rows.join(both.select("session_id", F.concat(F.lit("codex:response:"), "response").alias("id")).distinct(), ["session_id", "id"], "left_anti")
    forked = files.where("parent_id IS NOT NULL AND parent_id <> session_id").select("session_id", "forked_ms").withColumn("forked", F.lit(True))
    rows = rows.join(forked, "session_id", "left").where("forked_ms IS NULL OR ms >= forked_ms")
    key = ["ms", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens"]
    held = rows.select(F.col("session_id").alias("ancestor"), *key).distinct()
    up = ancestors(files, depth).join(held, "ancestor").groupBy("session_id", *key).agg(F.array_sort(F.collect_set("distance")).alias("d"))
    run = F.aggregate("d", F.lit(0), lambda n, x: F.when(x == n + 1, x).otherwise(n))
    copies = up.where(run % 2 == 1).select("session_id", *key, F.lit(True).alias("copy"))
    marked = rows.join(copies, ["session_id", *key], "left")
    return marked.where("copy IS NULL OR forked IS NULL OR NOT startswith(id, 'codex:total:')").drop("copy", "forked", "forked_ms")


def original_owners(rows: DataFrame, files: DataFrame, depth: int = 32) -> DataFrame:
    """Rows of copied branches with the session that they came from: the parent is the owner while it holds the same entry
    (native_id, ms), or the entry is older than the copy, and so on up the chain. Moved rows get the owner's session and
    id, the old id as `withdrawn`, and yield to the owner's own row."""
    up = ancestors(files, depth)
    # what a step from distance - 1 to distance needs: the time at which the lower one was copied
    below = up.select("session_id", F.col("ancestor").alias("lower"), F.col("distance") + 1).toDF("session_id", "lower", "distance").union(files.select("session_id", F.col("session_id").alias("lower"), F.lit(1).alias("distance")))
    steps = up.join(below, ["session_id", "distance"]).join(files.select(F.col("session_id").alias("lower"), "forked_ms"), "lower", "left").select("session_id", "ancestor", "distance", "forked_ms")
    named = rows.where("native_id IS NOT NULL")
    held = named.select(F.col("session_id").alias("ancestor"), "native_id", "ms").distinct().withColumn("held", F.lit(True))
    tried = named.select("session_id", "native_id", "ms").distinct().join(steps, "session_id").join(held, ["ancestor", "native_id", "ms"], "left")
    ok = F.coalesce("held", F.lit(False)) | F.coalesce(F.col("ms") < F.col("forked_ms"), F.lit(False))
    reach = tried.groupBy("session_id", "native_id", "ms").agg(F.min(F.when(~ok, F.col("distance"))).alias("stop"), F.max("distance").alias("most")).select("session_id", "native_id", "ms", F.coalesce(F.col("stop") - 1, "most").alias("distance")).where("distance > 0")
    owner = reach.join(up, ["session_id", "distance"]).select("session_id", "native_id", "ms", F.col("ancestor").alias("owner"))
    out = rows.join(owner, ["session_id", "native_id", "ms"], "left")
    moved = F.col("owner").isNotNull()
    return out.withColumns({
        "withdrawn": F.when(moved, F.col("id")), "id": F.when(moved, F.concat(F.col("harness"), F.lit(":"), "owner", F.lit(":"), "native_id")).otherwise(F.col("id")),
        "session_id": F.coalesce("owner", "session_id"), "sidechain": F.col("sidechain") | moved,
    }).drop("owner")


def parent_projects(rows: DataFrame, files: DataFrame, unknown: str, depth: int = 32) -> DataFrame:
    """Rows whose project is unknown with that of their session's nearest ancestor that has one."""
    known = rows.groupBy("session_id").agg(F.min_by("project", F.struct("ms", "id")).alias("own"), F.min_by(F.when(F.col("project") != unknown, F.col("project")), F.when(F.col("project") != unknown, F.struct("ms", "id"))).alias("project"))
    every = files.select("session_id", "parent_id").join(known.select("session_id", "project"), "session_id", "full")
    found = inherited_project(every, depth).withColumnRenamed("project", "near")
    return rows.join(found, "session_id", "left").withColumn("project", F.when(F.col("project") == unknown, F.coalesce("near", "project")).otherwise(F.col("project"))).drop("near")


def near_in_time(rows: DataFrame, parents: DataFrame, keys: list[str], within_ms: int = 2) -> DataFrame:
    """rows that have a row of parents with equal keys at most within_ms away: an equi-join on each offset."""
    offsets = F.explode(F.sequence(F.col("ms") - within_ms, F.col("ms") + within_ms))
    near = parents.select(*keys, offsets.alias("ms")).distinct()
    return rows.join(near, [*keys, "ms"], "left_semi")


def retracted(candidates: DataFrame, retained: DataFrame) -> DataFrame:
    """Ids that were reported or withdrawn by files and aren't retained."""
    return candidates.select("id").distinct().join(retained.select("id"), "id", "left_anti")
