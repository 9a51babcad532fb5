"""Generators and steps of conversations matched into calls by the aliases that they share.

A call is recorded by a generator, by a step, or by both. Each holds up to three aliases: response id, message id and the
provider's id. Two records are compatible if their response ids are equal, or, where one has none, if they share an alias or
one has no alias at all. An alias that occurs with two response ids is ambiguous and decides nothing for a record that has a
response id of its own.

Everything is joined on (conversation, alias) or (conversation, step), after aggregates for each alias: no join pairs the
records that share an alias with each other. Only the order-dependent rule for the steps that are left runs by conversation.

Tables, with empty text or null for what is unknown:

* generators: conversation, idx, step_indices, response_id, message_id, provider_id, response_model, planner_model,
  model_enum, execution_id, tier, input_tokens (null: no usage), output_tokens, cache_read_tokens, cache_write_tokens,
  thinking_tokens, response_tokens
* steps: the same without step_indices and models, with stamp (a time, or null)
* executors: conversation, idx, execution_id, model
* conversations: conversation, fallback_stamp
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metergrid.sources.generations import fallback_model, merged_copies, response_model
from metergrid.sources.threads import encoded
from metergrid.tables import Scratch

ALIASES = ("response_id", "message_id", "provider_id")
TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
#: Steps sort after the generators of their conversation.
STEP_ORDER = 1 << 40


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def aliases(prefix: str = "") -> Column:
    """The aliases of a record in their order, each once."""
    return F.array_distinct(F.filter(F.array(*[_text(prefix + a) for a in ALIASES]), lambda a: a != ""))


def compatible(left_id: Column, left: Column, right_id: Column, right: Column) -> Column:
    both = (left_id != "") & (right_id != "")
    return F.when(both, left_id == right_id).otherwise((F.size(left) == 0) | (F.size(right) == 0) | F.arrays_overlap(left, right))


def _records(rows: DataFrame) -> DataFrame:
    """Usage, aliases and token counts as the rules take them: output falls back on its parts, reasoning is part of output."""
    output = F.when(F.coalesce("output_tokens", F.lit(0)) > 0, F.col("output_tokens")).otherwise(F.coalesce("thinking_tokens", F.lit(0)) + F.coalesce("response_tokens", F.lit(0)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    kept = rows.withColumn("has_usage", F.col("input_tokens").isNotNull()).withColumn("output_tokens", output)
    kept = kept.withColumn("reasoning_tokens", F.least("output_tokens", zero("thinking_tokens"))).withColumns({c: zero(c) for c in TOKENS if c != "output_tokens"})
    kept = kept.withColumn("total", sum((F.col(c) for c in TOKENS[1:]), F.col(TOKENS[0]))).withColumn("rid", _text("response_id")).withColumn("aliases", aliases())
    return kept.withColumn("tier", F.lower(F.trim(_text("tier")))).withColumn("execution_id", _text("execution_id")).withColumn("model_enum", zero("model_enum"))


def alias_facts(generators: DataFrame, steps: DataFrame) -> DataFrame:
    """(conversation, alias): steps that hold it and the only or first of them, the same of those without a response id,
    whether it is ambiguous, the one response id it occurs with, and whether it, or that one, is the response id of a step."""
    held = steps.where("has_usage").select("conversation", F.explode("aliases").alias("alias"), "idx", "rid")
    bare = F.when(F.col("rid") == "", F.col("idx"))
    exact = F.when(F.col("rid") == F.col("alias"), F.col("idx"))
    by_steps = held.groupBy("conversation", "alias").agg(
        F.count("*").alias("holders"), F.min("idx").alias("holder"), F.count(bare).alias("bare_holders"), F.min(bare).alias("bare_holder"), F.min(exact).alias("step_of_id")
    )
    named = steps.where("has_usage").select("conversation", "rid", "aliases").unionByName(generators.where("has_usage").select("conversation", "rid", "aliases"))
    named = named.where("rid <> ''").select("conversation", "rid", F.explode("aliases").alias("alias")).where("alias <> rid")
    ids = named.groupBy("conversation", "alias").agg(F.min("rid").alias("low"), F.max("rid").alias("high"))
    ids = ids.select("conversation", "alias", (F.col("low") != F.col("high")).alias("ambiguous"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("unique_id"))
    facts = by_steps.join(ids, ["conversation", "alias"], "full").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))
    of_steps = by_steps.where("step_of_id IS NOT NULL").select("conversation", F.col("alias").alias("unique_id"), F.lit(True).alias("unique_is_step"))
    return facts.join(of_steps, ["conversation", "unique_id"], "left").withColumn("unique_is_step", F.coalesce("unique_is_step", F.lit(False)))


def _looked_up(rows: DataFrame, names: str, facts: DataFrame, out: str) -> DataFrame:
    """rows with `out`: the facts of each alias in the array `names`, in its order; null where it is empty. Rows are told by
    (conversation, idx)."""
    known = [c for c in facts.columns if c not in ("conversation", "alias")]
    each = rows.select("conversation", "idx", F.posexplode(names).alias("place", "alias")).join(facts, ["conversation", "alias"], "left")
    found = each.groupBy("conversation", "idx").agg(F.array_sort(F.collect_list(F.struct("place", "alias", *known))).alias(out))
    return rows.join(found, ["conversation", "idx"], "left")


def matched(generators: DataFrame, steps: DataFrame, facts: DataFrame) -> DataFrame:
    """Generators with usage and the step that each belongs to (matched, s_*), the first step that it refers to and that is
    there (fallback), and the first time among those (ref_stamp).

    The step: one with its response id, preferably one that it refers to; else by its aliases in their order a compatible
    one that it refers to, or the only compatible one; else, of those it refers to, the first compatible one with usage or
    the first without usage."""
    g = generators.where("has_usage")
    held = steps.select("conversation", F.col("idx").alias("step"), *[F.col(c).alias(f"s_{c}") for c in ("rid", "aliases", "has_usage", "stamp")])
    refs = g.select("conversation", "idx", "rid", "aliases", F.posexplode("step_indices").alias("place", "step")).join(held, ["conversation", "step"])
    fits = F.col("s_has_usage") & compatible(F.col("rid"), F.col("aliases"), F.col("s_rid"), F.col("s_aliases"))
    hits = [F.min(F.when(fits & F.array_contains("s_aliases", F.get("aliases", F.lit(i))), F.col("step"))).alias(f"ref_{i}") for i in range(len(ALIASES))]
    by_place = lambda value, when: F.min_by(value, F.when(when, F.col("place")))
    found = refs.groupBy("conversation", "idx").agg(
        F.min(F.when(F.col("s_has_usage") & (F.col("rid") != "") & (F.col("rid") == F.col("s_rid")), F.col("step"))).alias("ref_exact"),
        *hits,
        by_place("step", fits).alias("ref_fit"),
        by_place("step", ~F.col("s_has_usage")).alias("ref_plain"),
        F.min_by("step", "place").alias("fallback"),
        by_place("s_stamp", F.col("s_stamp").isNotNull()).alias("ref_stamp"),
    )
    g = _looked_up(g.join(found, ["conversation", "idx"], "left"), "aliases", facts, "own_facts")
    exact = F.get(F.filter("own_facts", lambda f: f["alias"] == F.col("rid")), F.lit(0))["step_of_id"]

    def by_alias(i: int) -> Column:
        f = F.get("own_facts", F.lit(i))
        only = F.when(F.col("rid") == "", F.when(f["holders"] == 1, f["holder"])).when(f["bare_holders"] == 1, f["bare_holder"])
        return F.coalesce(F.col(f"ref_{i}"), only)

    g = g.withColumn("matched", F.coalesce("ref_exact", exact, *[by_alias(i) for i in range(len(ALIASES))], "ref_fit", "ref_plain"))
    names = ("rid", "aliases", "has_usage", "stamp", "model_enum", "execution_id", "tier", *ALIASES)
    of_step = steps.select("conversation", F.col("idx").alias("matched"), *[F.col(c).alias(f"s_{c}") for c in names])
    g = g.join(of_step, ["conversation", "matched"], "left")
    fit = F.coalesce(F.col("s_has_usage") & compatible(F.col("rid"), F.col("aliases"), F.col("s_rid"), F.col("s_aliases")), F.lit(False))
    g = g.withColumn("fit", fit).withColumn("fit_step", F.col("matched").isNotNull() & (F.col("fit") | ~F.col("s_has_usage")))
    ids = F.when(F.col("fit"), F.nullif(F.when(F.col("rid") != "", F.col("rid")).otherwise(F.col("s_rid")), F.lit("")))
    step = Window.partitionBy("conversation", "matched")
    return g.withColumn("shared", F.coalesce(F.min(ids).over(step) != F.max(ids).over(step), F.lit(False)))


def canonical(rid: Column, names: Column, own: Column, step_rid: Column, step_alias: Column, facts: Column) -> Column:
    """The lasting id of a call: a step's response id that it has or that one of its aliases leads to; else an alias of its
    step, or one that a step holds, unless it is ambiguous; else the response id, its own or the one it leads to; else its
    first alias. `names`: aliases of the call and its step, `facts` what is known of them, `own` those of the call alone."""
    explicit = F.when(rid != "", rid).otherwise(step_rid)
    leads = F.get(F.filter(facts, lambda f: f["unique_id"].isNotNull()), F.lit(0))
    promoted = F.when(explicit != "", explicit).otherwise(leads["unique_id"])
    is_step = F.when(explicit != "", F.exists(facts, lambda f: (f["alias"] == explicit) & f["step_of_id"].isNotNull())).otherwise(leads["unique_is_step"])
    vague = lambda f: (rid != "") & f["ambiguous"]
    of_step = F.get(F.filter(facts, lambda f: f["alias"] == step_alias), F.lit(0))
    held = F.get(F.filter(facts, lambda f: (f["alias"] != rid) & f["holders"].isNotNull() & ~F.coalesce(vague(f), F.lit(False))), F.lit(0))["alias"]
    return F.coalesce(F.when(F.coalesce(is_step, F.lit(False)), promoted), F.when(~F.coalesce(vague(of_step), F.lit(False)), step_alias), held, promoted, F.get(own, F.lit(0)))


def _id(kind: str, value: Column) -> Column:
    return F.concat(F.lit("antigravity:"), encoded(F.col("conversation")), F.lit(f":{kind}:"), value.cast("string") if kind != "response" else encoded(value))


def enum_models(generators: DataFrame) -> DataFrame:
    """(conversation, model_enum, enum_model): the first generator that names a model gives its number that name."""
    named = generators.withColumn("named", explicit_model()).where("named IS NOT NULL AND model_enum > 0")
    return named.groupBy("conversation", "model_enum").agg(F.min_by("named", "idx").alias("enum_model"))


def explicit_model() -> Column:
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(response_model(_text("response_model"))), some(fallback_model(_text("planner_model"))))


def first_in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a conversation's steps, in order, those that no earlier one of them covers: one that shares an alias, where the
    response ids are equal or one is missing."""
    held: dict[str, set[str]] = {}
    kept = []
    for k, rid, names in sorted(zip(rows["idx"], rows["rid"], rows["aliases"], strict=True), key=lambda r: r[0]):
        if any(held.get(a) and (not rid or "" in held[a] or rid in held[a]) for a in names):
            continue
        kept.append(k)
        for a in names:
            held.setdefault(a, set()).add(rid)
    return pd.DataFrame({"conversation": [rows["conversation"].iloc[0]] * len(kept), "idx": kept})


def reconcile(generators: DataFrame, steps: DataFrame, executors: DataFrame, conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(calls, withdrawn ids). Calls: id, conversation, stamp, model, tier and token counts, one row an id. A generator with
    usage is a call under its canonical id, or that of its step or its own number; a step with usage is one where no call
    covers it. Records without tokens or time are left out. Withdrawn are all other ids that a call could have had before.
    `scratch` holds the tables that are read more than once: the records, the matched generators and the steps that are left while the results are read."""
    # each is read for facts, matches, models and what is left
    generators, steps = scratch.written(_records(generators), "generators"), scratch.written(_records(steps), "steps")
    facts = scratch.written(alias_facts(generators, steps), "aliases")
    spare = scratch.written(conversations.select("conversation", "fallback_stamp"), "conversations")
    enums, runs = scratch.written(enum_models(generators), "enums"), scratch.written(run_models(executors), "runs")
    g = matched(generators, steps, facts).withColumn("names", F.when(F.col("fit"), F.array_union("aliases", "s_aliases")).otherwise(F.col("aliases")))
    g = _looked_up(g, "names", facts, "facts").join(spare, "conversation", "left")
    step_rid, step_alias = (F.when(F.col("fit"), c) for c in (F.col("s_rid"), F.get("s_aliases", F.lit(0))))
    g = g.withColumn("call", canonical(F.col("rid"), F.col("names"), F.col("aliases"), F.coalesce(step_rid, F.lit("")), step_alias, F.col("facts")))
    g = g.withColumn("stamp", F.coalesce("s_stamp", "ref_stamp", "fallback_stamp")).where("stamp IS NOT NULL AND total > 0")
    prices = F.col("fit_step") & ~F.col("shared")
    enum = F.when(F.col("model_enum") > 0, F.col("model_enum")).otherwise(F.coalesce(F.when(prices, F.col("s_model_enum")), F.lit(0)))
    run = F.when(F.col("execution_id") != "", F.col("execution_id")).otherwise(F.when(prices, F.col("s_execution_id")))
    g = g.withColumn("model_enum", enum).withColumn("execution_id", run).withColumn("named", explicit_model())
    g = g.withColumn("tier", F.when(F.col("tier") != "", F.col("tier")).otherwise(F.coalesce(F.when(prices & F.col("fit"), F.col("s_tier")), F.lit(""))))
    place = F.coalesce("matched", "fallback")
    g = g.withColumn("id", F.when(F.col("call").isNotNull(), _id("response", F.col("call"))).when(place.isNotNull(), _id("step", place)).otherwise(_id("gen", F.col("idx"))))
    g = scratch.written(_with_model(g, enums, runs), "matched")

    covers = g.withColumn("rid", F.when(F.col("rid") == "", F.coalesce(step_rid, F.lit(""))).otherwise(F.col("rid")))
    merged = lambda a: F.when(_text(a) != "", _text(a)).otherwise(F.when(F.col("fit"), _text(f"s_{a}")).otherwise(""))
    covers = covers.select("conversation", "rid", F.explode(F.array_distinct(F.filter(F.array(*[merged(a) for a in ALIASES]), lambda a: a != ""))).alias("alias"))
    by_alias = covers.groupBy("conversation", "alias").agg(F.bool_or(F.col("rid") == "").alias("any_id"))
    by_id = covers.where("rid <> ''").distinct()
    used = steps.where("has_usage")
    each = used.select("conversation", "idx", "rid", F.explode("aliases").alias("alias"))
    covered = each.join(by_alias, ["conversation", "alias"]).where("rid = '' OR any_id").select("conversation", "idx")
    covered = covered.union(each.join(by_id, ["conversation", "alias", "rid"], "left_semi").select("conversation", "idx"))
    near = g.where("fit_step").select("conversation", F.col("matched").alias("idx")).union(g.select("conversation", F.explode("step_indices").alias("idx")))
    left = used.where("size(aliases) > 0").join(covered.distinct(), ["conversation", "idx"], "left_anti")
    left = left.unionByName(used.where("size(aliases) = 0").join(near.distinct(), ["conversation", "idx"], "left_anti"))
    left = left.join(spare, "conversation", "left").withColumn("stamp", F.coalesce("stamp", "fallback_stamp")).where("stamp IS NOT NULL AND total > 0")
    left = scratch.written(left.withColumn("named", F.lit(None).cast("string")), "left")
    first = left.where("size(aliases) > 0").select("conversation", "idx", "rid", "aliases").groupBy("conversation").applyInPandas(first_in_order, "conversation string, idx long")
    s = left.where("size(aliases) = 0").unionByName(left.where("size(aliases) > 0").join(first, ["conversation", "idx"], "left_semi"))
    s = _looked_up(s, "aliases", facts, "facts")
    s = s.withColumn("call", canonical(F.col("rid"), F.col("aliases"), F.col("aliases"), F.lit(""), F.lit(None).cast("string"), F.col("facts")))
    s = s.withColumn("id", F.when(F.col("call").isNotNull(), _id("response", F.col("call"))).otherwise(_id("step", F.col("idx"))))
    s = _with_model(s, enums, runs)

    out = ("id", "conversation", "stamp", "model", "tier", *TOKENS, "reasoning_tokens")
    rows = g.select(*out, F.col("idx").alias("seq")).unionByName(s.select(*out, (F.col("idx") + STEP_ORDER).alias("seq")))
    calls = merged_copies(rows, "seq").select(*out)

    other = lambda df, names: df.where("call IS NOT NULL").select("conversation", "call", F.explode(names).alias("alias")).where("alias <> call").select(_id("response", F.col("alias")).alias("id"))
    gone = other(g, "names").union(other(s, "aliases"))
    gone = gone.union(g.where("call IS NOT NULL AND fit_step").select(_id("step", F.col("matched")))).union(s.where("call IS NOT NULL").select(_id("step", F.col("idx"))))
    gone = gone.union(g.where(F.col("call").isNotNull() | F.col("fit_step")).select(_id("gen", F.col("idx"))))
    # rows have the ids of the calls that they are merged into
    return calls, gone.distinct().join(rows.select("id"), "id", "left_anti")


def run_models(executors: DataFrame) -> DataFrame:
    """(conversation, execution_id, run_model): the last executor that names a model."""
    runs = executors.withColumn("model", fallback_model(F.col("model"))).where("execution_id <> '' AND model <> ''")
    return runs.groupBy("conversation", "execution_id").agg(F.max_by("model", "idx").alias("run_model"))


def _with_model(rows: DataFrame, enums: DataFrame, runs: DataFrame) -> DataFrame:
    """The model named, else that of its number, else that of its execution, else unknown."""
    found = rows.join(enums, ["conversation", "model_enum"], "left").join(runs, ["conversation", "execution_id"], "left")
    return found.withColumn("model", F.coalesce("named", "enum_model", "run_model", F.lit("unknown"))).drop("enum_model", "run_model")
