"""What a page shows of the aggregates: top rows, aligned series, tails, shares and pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metergrid.functions.expr import numeric_sort_key, project_label, project_parts, round_cost

TOP, PAGE = 10, 12


def top_rows(groups: DataFrame, top: int = TOP) -> DataFrame:
    """Rows among the `top` by tokens or by rounded cost, with the number of all rows."""
    by_tokens = F.row_number().over(Window.orderBy(F.desc("tokens"), F.asc("name")))
    by_cost = F.row_number().over(Window.orderBy(round_cost(F.col("cost_usd")).desc(), F.desc("tokens"), F.asc("name")))
    total = F.count("*").over(Window.partitionBy())
    return groups.select("*", by_tokens.alias("by_tokens"), by_cost.alias("by_cost"), total.alias("total_count")).where((F.col("by_tokens") <= top) | (F.col("by_cost") <= top))


def aligned(cells: DataFrame, buckets: DataFrame, key: str) -> DataFrame:
    """(name, t, c, u): arrays with a place for each bucket in order, zeros where a name has no cell; u is null where
    it is zero throughout. cells (key, name, tokens, cost_usd, unpriced_tokens); buckets holds one row for each key."""
    keys = buckets.agg(F.sort_array(F.collect_list(key)).alias("keys"))
    held = cells.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), F.struct("tokens", "cost_usd", "unpriced_tokens")))).alias("cell"))
    at = lambda f, zero: F.transform("keys", lambda k: F.coalesce(F.col("cell")[k][f], zero))
    rows = held.join(F.broadcast(keys), how="cross")  # one row: the buckets of a period
    u = at("unpriced_tokens", F.lit(0).cast("long"))
    return rows.select("name", at("tokens", F.lit(0).cast("long")).alias("t"), F.transform(at("cost_usd", F.lit(0.0)), round_cost).alias("c"), F.when(F.exists(u, lambda x: x > 0), u).alias("u"))


def with_tails(cells: DataFrame, key: str, top: int = TOP) -> DataFrame:
    """Cells with their rank in the bucket and what the ranks beyond `top` have together, by tokens and by cost."""
    by_tokens = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("tokens"), F.asc("name")))
    by_cost = F.row_number().over(Window.partitionBy(key).orderBy(round_cost(F.col("cost_usd")).desc(), F.asc("name")))
    ranks = cells.select("*", by_tokens.alias("rank"), by_cost.alias("cost_rank"))
    whole = Window.partitionBy(key)
    other = lambda c, r: F.coalesce(F.sum(F.when(F.col(r) > top, F.col(c))).over(whole), F.lit(0))
    return ranks.select("*", other("tokens", "rank").alias("other_tokens"), F.round(other("cost_usd", "cost_rank"), 9).alias("other_cost")).where((F.col("rank") <= top) | (F.col("cost_rank") <= top)).drop("cost_rank")


def shares(groups: DataFrame) -> DataFrame:
    """Each row's share of all tokens."""
    return groups.withColumn("share", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), 6))


#: Sort keys of sessions, and whether they are text.
SORTS = {"active": False, "started": False, "project": True, "model": True, "device": True, "tokens": False, "cost": False}


def session_order(key: str = "active", descending: bool | None = None) -> list[Column]:
    """Text is compared without case and accents and by the value of its numbers, first to last unless asked otherwise;
    a project by its label. Ties go to the latest, then by id."""
    if key not in SORTS:
        raise ValueError(f"sessions can't be sorted by {key}")
    column = {"active": "last_active_ms", "started": "started_ms", "cost": "cost_usd"}.get(key, key)
    value = project_label(F.coalesce("repository", "project")) if key == "project" else F.col(column)
    value = numeric_sort_key(F.coalesce(value, F.lit(""))) if SORTS[key] else value
    descending = not SORTS[key] if descending is None else descending
    return [value.desc() if descending else value.asc(), F.desc("last_active_ms"), F.asc("session_id"), F.asc("device"), F.asc("harness")]


def page(rows: DataFrame, order: list[Column], number: int, size: int = PAGE) -> DataFrame:
    """Page `number` (from 1; beyond the last one, the last) of rows with their rank: one sort with a limit. If fewer
    rows come than asked for, they are all there are, which gives the last page."""
    number = max(1, number)
    kept = rows.orderBy(*order).limit(number * size)
    ranked = kept.withColumns({"rank": F.row_number().over(Window.orderBy(*order)), "_all": F.count("*").over(Window.partitionBy())})
    last = F.least(F.lit(number), F.greatest(F.lit(1), F.ceil(F.col("_all") / size)))
    return ranked.where((F.col("rank") > (last - 1) * size) & (F.col("rank") <= last * size)).drop("_all")


def project_labels(keys: DataFrame, column: str = "project_key") -> DataFrame:
    """(key, label): as many trailing path parts (two at least) as tell a key from all others, or the whole key."""
    parts = project_parts(F.col("key"))
    rows = keys.select(F.col(column).alias("key")).where("key IS NOT NULL").distinct().withColumn("parts", parts)
    depth = F.explode(F.when(F.size("parts") >= 2, F.sequence(F.lit(2), F.size("parts"))).otherwise(F.array(F.lit(1))))
    tails = rows.select("key", depth.alias("depth"), "parts").withColumn("label", F.coalesce(F.nullif(F.array_join(F.slice("parts", F.greatest(F.lit(1), F.size("parts") - F.col("depth") + 1), F.col("depth")), "/"), F.lit("")), F.col("key")))
    used = tails.groupBy("label", "depth").agg(F.count_distinct("key").alias("keys"))
    alone = tails.join(used, ["label", "depth"]).where("keys = 1").groupBy("key").agg(F.min_by("label", "depth").alias("label"))
    return rows.select("key").join(alone, "key", "left").select("key", F.coalesce("label", "key").alias("label"), project_label(F.col("key")).alias("short"))


def catalog_search(catalog: DataFrame, text: str, most: int = 60) -> DataFrame:
    """Catalog models that match a search text, best class of match first; a top-k report."""
    wanted = text.strip().lower()
    name = F.lower("model")
    base = F.substring_index(name, "/", -1)
    kind = (
        F.when(name == wanted, 0).when(base == wanted, 1).when(name.startswith(wanted), 2).when(base.startswith(wanted), 3)
        .when(name.contains("/" + wanted) | name.contains("-" + wanted), 4).when(base.contains(wanted), 5).when(name.contains(wanted), 6)
    )
    found = catalog.select("model").distinct().select("model", kind.alias("kind"), F.size(F.split(name, "/")).alias("segments"), F.char_length(base).alias("length")).where("kind IS NOT NULL")
    order = [F.asc("kind"), F.asc("segments"), F.asc("length"), F.asc("model")]
    return found.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def batches(rows: DataFrame, keys: list[str], order: list[str], size: str, most_rows: int = 500, most_bytes: int = 256 << 10) -> DataFrame:
    """Adds batch: upload batches, from 0 within each of the keys. A batch is closed when the next row would take it over
    most_rows rows or most_bytes bytes (size and a separator each). A stream over the sorted rows: a task holds one
    Arrow batch and two counters, so keys of any size are split between devices, or devices and days."""
    names = rows.columns

    def run(parts):
        key, batch, count, held = None, 0, 0, 0
        for part in parts:
            found = []
            for row in zip(*[part.column(k).to_pylist() for k in (*keys, size)], strict=True):
                more = row[-1] + 1
                if row[:-1] != key:
                    key, batch, count, held = row[:-1], 0, 0, 0
                elif count >= most_rows or held + more > most_bytes:
                    batch, count, held = batch + 1, 0, 0
                count, held = count + 1, held + more
                found.append(batch)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.int64())], names=[*names, "batch"])

    sorted_ = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return sorted_.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())]))


def label_overrides(labels: DataFrame) -> DataFrame:
    """(key, label) of project_labels() that differ from the short label."""
    return labels.where("label <> short AND key <> ''").select("key", "label")


def device_suffixes(devices: DataFrame) -> DataFrame:
    """(id, suffix) of devices (id, label) whose label others have too: as many last letters of the id, four at least, as
    tell those of one label apart."""
    alike = devices.select("id", "label").distinct()
    alike = alike.join(alike.groupBy("label").agg(F.count("*").alias("n"), F.max(F.char_length("id")).alias("longest")).where("n > 1"), "label")
    tails = alike.withColumn("length", F.explode(F.sequence(F.lit(4), F.greatest(F.lit(4), F.col("longest"))))).withColumn("suffix", F.expr("right(id, length)"))
    told = tails.groupBy("label", "length", "n").agg(F.count_distinct("suffix").alias("different")).where("different = n").groupBy("label").agg(F.min("length").alias("length"))
    return tails.join(told, ["label", "length"]).select("id", "suffix")


def session_rows(sessions: DataFrame, models: DataFrame) -> DataFrame:
    """Sessions as a page shows them: the project's key, a rounded cost, and multi_model where the joined models are
    none of `models` (model)."""
    known = models.select("model", F.lit(False).alias("multi_model")).distinct()
    kept = ["session_title", "project_name", "thread_id", "thread_url", "session_id", "harness", "model", F.coalesce("repository", "project").alias("project"), "device", "started_ms", "last_active_ms", "tokens"]
    return sessions.join(known, "model", "left").select(*kept, round_cost(F.col("cost_usd")).alias("cost_usd"), F.when(F.col("unpriced_tokens") > 0, F.col("unpriced_tokens")).alias("unpriced_tokens"), F.coalesce("multi_model", F.lit(True)).alias("multi_model"))


def day_buckets(days: DataFrame, last: str) -> DataFrame:
    """Buckets (first, last, ...) with short and label, and partial for the one that the period ends in."""
    short = lambda c: F.concat_ws(" ", F.date_format(c, "MMM"), F.dayofmonth(c).cast("string"))
    label = F.when(F.col("last").isNotNull(), F.concat_ws(" – ", short("first"), short("last"))).otherwise(short("first"))
    return days.select("*", short("first").alias("short"), label.alias("label"), (F.coalesce("last", "first") == F.lit(last).cast("date")).alias("partial"))


def hour_buckets(hours: DataFrame, now_ms: int) -> DataFrame:
    """Hours (hour, first_ms, ...) with partial for the one that holds now."""
    return hours.withColumn("partial", (F.col("first_ms") <= now_ms) & (F.lit(now_ms) < F.col("first_ms") + 3_600_000))


def neighbours(buckets: DataFrame, key: str, chosen: str | None) -> DataFrame:
    """The chosen bucket with the keys of the ones before and after; none if no bucket has this key. Without a choice, a
    row whose neighbours are the last and the first bucket."""
    over = Window.orderBy(key)  # a row for each bucket of a period
    if chosen is None:
        return buckets.agg(F.lit(None).cast("string").alias("key"), F.max(key).cast("string").alias("before"), F.min(key).cast("string").alias("after"))
    placed = buckets.select(F.col(key).cast("string").alias("key"), F.lag(key).over(over).cast("string").alias("before"), F.lead(key).over(over).cast("string").alias("after"))
    return placed.where(F.col("key") == chosen)


def project_index(insights: DataFrame, keys: DataFrame) -> DataFrame:
    """What projects are searched by: one row for each key of `keys` (project_key) and of insights, with its label, paths,
    names, latest activity and measures (null where it has none in the period)."""
    every = keys.select(F.col("project_key").alias("key")).union(insights.select(F.col("name"))).where("key IS NOT NULL").distinct()
    labels = project_labels(every, "key").select("key", F.coalesce(F.nullif("label", F.lit("")), F.lit("Unknown project")).alias("label"))
    found = insights.select(F.col("name").alias("key"), "paths", "project_names", "last_active_ms", "tokens", "cost_usd", "sessions", "unpriced_tokens")
    return labels.join(found, "key", "left")


def _plain(text: Column) -> Column:
    """Lower case without accents, which NFD would split off."""
    return F.lower(F.translate(text, "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"))


def _literal(fields: Column, term: str) -> Column:
    """The best place of a term in fields: the first field is the label, and counts more."""
    at = lambda f: F.instr(f, F.lit(term))
    one = lambda f: F.when(f == term, 100).when(f.startswith(term), 80).when(at(f) > 0, 60 - F.least(at(f) - 1, F.lit(20)))
    return F.array_max(F.transform(fields, lambda f, i: one(f) + F.when(i == 0, 20).otherwise(0)))


def _fuzzy(fields: Column, term: str) -> Column:
    """Letters of a term in order and close together, in a name: 10 and more, null where they aren't there."""
    if len(term) < 3 or "/" in term or "\\" in term:
        return F.lit(None).cast("double")

    def best(field: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(field))), lambda p: F.substr(field, p, F.lit(1)) == term[0])
        end = lambda p: F.aggregate(F.array(*[F.lit(c) for c in term[1:]]), p, lambda at, c: F.when(at > 0, F.when(F.instr(F.substr(field, at + 1), c) > 0, at + F.instr(F.substr(field, at + 1), c)).otherwise(0)).otherwise(0))
        spans = F.transform(starts, lambda p: F.when(end(p) > 0, end(p) - p + 1))
        return F.array_max(F.transform(F.filter(spans, lambda n: n <= len(term) * 3 + 1), lambda n: 10 + F.lit(float(len(term))) / n))

    return F.array_max(F.transform(fields, best))


PROJECT_SORTS = {"tokens": "tokens", "cost": "cost_usd", "recent": "last_active_ms", "name": None}


def search_projects(index: DataFrame, query: str, sort: str = "tokens") -> DataFrame:
    """Rows of project_index() that match every term of the query, best first: a term counts where it stands in label,
    key, paths and names, or by its letters in their last parts."""
    split = lambda c: F.coalesce(F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: x != ""), F.array())
    base = lambda x: F.coalesce(F.try_element_at(F.filter(F.split(x, r"[\\/]"), lambda y: y != ""), F.lit(-1)), x)
    paths, names = split(F.col("paths")), split(F.col("project_names"))
    fields = F.transform(F.concat(F.array("label", "key"), paths, names), _plain)
    fuzzy = F.transform(F.concat(F.array(base(F.col("key"))), F.transform(paths, base), F.transform(names, base)), _plain)
    rows = index.withColumns({"fields": fields, "fuzzy": fuzzy})
    text = query.strip().lower()
    terms = text.split()
    if terms:
        score = F.lit(0.0)
        for term in terms:
            score = score + F.coalesce(_literal(F.col("fields"), term).cast("double"), _fuzzy(F.col("fuzzy"), term))
        whole = F.when(F.exists("fields", lambda f: F.contains(f, F.lit(text))), 50.0).otherwise(0.0)
        rows = rows.withColumn("score", score + whole).where("score IS NOT NULL")
    else:
        rows = rows.withColumn("score", F.lit(0.0))
    column = PROJECT_SORTS[sort]
    order = [F.desc("score"), *([F.coalesce(F.col(column), F.lit(-1)).desc()] if column else []), F.asc("label"), F.asc("key")]
    return rows.drop("fields", "fuzzy").withColumn("rank", F.row_number().over(Window.orderBy(*order)))
