"""Prices: a rate catalog and saved rules are resolved for each model name, and applied row by row as expressions."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Field names of the catalog, name prefixes in the order they are tried, service tiers and flags.
INPUT, OUTPUT, READ = "input_cost_per_token", "output_cost_per_token", "cache_read_input_token_cost"
WRITE, WRITE_1H = "cache_creation_input_token_cost", "cache_creation_input_token_cost_above_1hr"
FIELDS = (INPUT, OUTPUT, READ, WRITE, WRITE_1H)
PREFIXES = ("openai/", "anthropic/", "xai/", "meta/")
TIERS = {"": "", "default": "", "standard": "", "priority": "_priority", "fast": "_priority", "ultrafast": "_ultrafast", "flex": "_flex", "batch": "_batches", "batches": "_batches"}
CONTEXTS = ((272_000, "_above_272k_tokens"), (200_000, "_above_200k_tokens"))
#: The suffixes of known tiers, and what stands for any other tier.
OTHER_TIER = "?"
KNOWN_TIERS = (*dict.fromkeys(TIERS.values()), OTHER_TIER)
#: Names with a release date.
DATED = "^claude-.*-[0-9]{8}$"
GAP = {"price": 1, "reported": 2, "metadata": 4, "tier": 8, "input": 16, "output": 32, "read": 64, "write": 128, "write_1h": 256}
RULE_RATES = {"input": INPUT, "output": OUTPUT, "cache_read": READ, "cache_write": WRITE, "cache_write_1h": WRITE_1H}


def check_rules(rules: list[dict]) -> None:
    """One rule a model, and no alias cycles."""
    models = [r["model"] for r in rules]
    if len(set(models)) < len(models):
        raise ValueError("a model has two rules")
    for row in resolved_rules(rules):
        if row[2] == "cycle":
            raise ValueError(f"alias cycle at {row[0]}")


def check_targets(catalog: DataFrame, rules: list[dict]) -> None:
    """Every alias ends in a price."""
    check_rules(rules)
    found = resolve_models(catalog.sparkSession.createDataFrame([(r["model"],) for r in rules], "raw_model string"), catalog, rules)
    if bad := [r["raw_model"] for r in found.where("kind = 'none'").collect()]:
        raise ValueError(f"no price for the target of {', '.join(sorted(bad))}")


def with_rule(catalog: DataFrame, rules: list[dict], rule: dict) -> list[dict]:
    """The rules with this one in place of the model's old one, sorted by model."""
    out = sorted([*(r for r in rules if r["model"] != rule["model"]), rule], key=lambda r: r["model"])
    check_targets(catalog, out)
    return out


def without_rule(catalog: DataFrame, rules: list[dict], model: str) -> list[dict]:
    out = [r for r in rules if r["model"] != model]
    check_targets(catalog, out)
    return out


def revision(catalog: DataFrame, rules: list[dict]) -> str:
    """A hash of the policy's content, whatever the order of its rates."""
    rates = catalog.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.concat_ws("/", "model", "field"), F.col("rate").cast("string")))), ","), 256)).first()[0]
    return hashlib.sha256(f"[{rates},{json.dumps(rules, sort_keys=True)}]".encode()).hexdigest()


def adopted(current: tuple[DataFrame, list[dict]], received: tuple[DataFrame, list[dict]], claimed: str, expected: str | None = None) -> tuple[DataFrame, list[dict]]:
    """The received policy, if its hash is the claimed one and the current policy is still the expected one."""
    check_targets(*received)
    if revision(*received) != claimed:
        raise ValueError("the policy isn't the one that was announced")
    now = revision(*current)
    if now == claimed:
        return current
    if expected is not None and now != expected:
        raise ValueError("the policy changed meanwhile")
    return received


def merged_catalogs(*catalogs: DataFrame) -> DataFrame:
    """Catalogs (model, field, rate) in one; of a model that several have, the last one's rates alone."""
    every = reduce(DataFrame.union, [c.select("model", "field", "rate", F.lit(i).alias("turn")) for i, c in enumerate(catalogs)])
    last = every.groupBy("model").agg(F.max("turn").alias("turn"))
    return every.join(last, ["model", "turn"]).select("model", "field", "rate")


# Fixed value: fields that are rates.
RATE_FIELD = "^(input_cost_per_token|output_cost_per_token|cache_read_input_token_cost|cache_creation_input_token_cost)(_|$)"


def decoded_catalog(raw: DataFrame, least: int = 100) -> DataFrame:
    """(model, field, rate) of an upstream catalog (model, value: JSON): models with both base rates. A rate that isn't a
    finite number of at least 0, or fewer models than `least`, refuse all of it."""
    fields = raw.where(F.ltrim("value").startswith("{")).select("model", F.explode(F.from_json("value", "map<string,string>")).alias("field", "text"))
    rates = fields.where(F.col("field").rlike(RATE_FIELD) & F.col("text").isNotNull()).withColumn("rate", F.col("text").try_cast("double"))
    good = F.coalesce((F.col("rate") >= 0) & (F.col("rate") < float("inf")), F.lit(False))
    if bad := rates.where(~good).count():
        raise ValueError(f"{bad} rates are invalid")
    whole = rates.groupBy("model").agg(F.count_if(F.col("field").isin(INPUT, OUTPUT)).alias("base")).where("base = 2").select("model")
    if whole.count() < least:
        raise ValueError("the catalog is incomplete")
    return rates.join(whole, "model", "left_semi").select("model", "field", "rate")


def resolved_rules(rules: list[dict]) -> list[tuple]:
    """(model, terminal, kind, display, rates) for each ruled model; kind is free, custom, alias or cycle."""
    by_model: dict[str, dict] = {}
    for r in rules:
        by_model.setdefault(r["model"], r)
    out = []
    for model in by_model:
        seen, at = [], model
        while at in by_model and by_model[at]["kind"] == "alias" and at not in seen:
            seen.append(at)
            at = by_model[at]["target"]
        last = by_model.get(at)
        if at in seen:
            out.append((model, model, "cycle", model, None))
        elif last and last["kind"] == "free":
            out.append((model, at, "free", at, None))
        elif last:
            rates = {RULE_RATES[k]: float(v) / 1e6 for k, v in last["rates"].items() if v is not None}
            out.append((model, at, "custom", last.get("nickname") or at, rates))
        else:
            out.append((model, at, "alias", None, None))
    return out


def resolve_models(models: DataFrame, catalog: DataFrame, rules: list[dict]) -> DataFrame:
    """(raw_model, model, kind, rates) for each raw_model of `models`; kind is free, custom, alias (a catalog entry
    behind an alias), catalog or none; rates map field to rate."""
    spark = models.sparkSession
    ruled = spark.createDataFrame(resolved_rules(rules), "raw_model string, terminal string, rule string, display string, own map<string,double>")
    found = models.select("raw_model").distinct().join(ruled, "raw_model", "left").withColumn("terminal", F.coalesce("terminal", "raw_model"))
    name = F.col("terminal")
    tries = [name]
    for p in PREFIXES:
        tries += [F.concat(F.lit(p), name), F.when(name.startswith(p), F.substring(name, len(p) + 1, 10_000))]
    tries.append(F.when(name.rlike(r"^claude-.*-\d{8}$"), F.regexp_replace(name, r"-\d{8}$", "")))
    needs = found.where("rule IS NULL OR rule = 'alias'").select("raw_model", F.posexplode(F.array(*tries)).alias("turn", "entry")).where("entry IS NOT NULL")
    rates = catalog.groupBy(F.col("model").alias("entry")).agg(F.map_from_entries(F.collect_list(F.struct("field", "rate"))).alias("rates"))
    hit = needs.join(rates, "entry").groupBy("raw_model").agg(F.min_by(F.struct("entry", "rates"), "turn").alias("hit"))
    kind = F.when(F.col("rule").isin("free", "custom"), F.col("rule")).when(F.col("hit").isNull(), "none").when(F.col("rule") == "alias", "alias").otherwise("catalog")
    return found.join(hit, "raw_model", "left").select(
        "raw_model",
        F.coalesce("display", "hit.entry", "raw_model").alias("model"),
        kind.alias("kind"),
        F.coalesce("own", "hit.rates").alias("rates"),
        F.col("rule").isNotNull().alias("ruled"),
    )


def shown_models(spark: SparkSession, names: tuple[str, ...], catalog: DataFrame, rules: list[dict]) -> tuple[str, ...]:
    """The names under which models are shown, each once: a filter may say them or the raw ones."""
    asked = spark.createDataFrame([(n,) for n in names], "raw_model string")
    found = {r["raw_model"]: r["model"] for r in resolve_models(asked, catalog, rules).collect()}
    return tuple(sorted({found[n] for n in names}))


#: Rates of a catalog that the driver resolves; a larger one is refused.
MOST_RATES = 1_000_000


@dataclass(frozen=True)
class Prices:
    """Two small tables that every executor gets: names (raw_model, entry, model, kind, ruled) of all names that a rule
    or the catalog knows, and rates (entry, tier_key, band, rated, tiered, r0 .. r4) of each entry for each service tier
    and prompt size, with the fallbacks worked out."""

    names: DataFrame
    rates: DataFrame


def _usable(rate: float | None) -> float | None:
    return rate if rate is not None and 0 <= rate < float("inf") else None


def _first(*rates: float | None) -> float | None:
    return next((r for r in rates if r is not None), None)


def _rate_rows(entry: str, kind: str, rates: dict[str, float]) -> list[tuple]:
    out = []
    aliased, falls = kind == "alias", kind in ("alias", "custom")
    for tier_key in KNOWN_TIERS:
        tier = "" if kind == "custom" or aliased and tier_key == OTHER_TIER else None if tier_key == OTHER_TIER else tier_key
        for band in range(len(CONTEXTS) + 1):
            context = next((s for i, (_, s) in enumerate(CONTEXTS) if band >= len(CONTEXTS) - i and rates.get(INPUT + s) is not None), "")
            of = lambda field, suffix: _usable(_first(rates.get(field + context + suffix), rates.get(field + suffix) if context else None))  # noqa: E731, B023
            own = [of(f, tier) if tier is not None else None for f in FIELDS]
            plain = [of(f, "") if falls else None for f in FIELDS]
            r0 = _first(own[0], plain[0])
            same = r0 if aliased else None
            r = [r0, _first(own[1], plain[1]), _first(own[2], plain[2], same), _first(own[3], plain[3], same)]
            r.append(_first(own[4], own[3], plain[4], plain[3], same) if falls else own[4])
            out.append((entry, tier_key, band, tier is not None, tier not in (None, ""), *r))
    return out


def price_tables(catalog: DataFrame, rules: list[dict]) -> Prices:
    """The catalog's and the rules' prices. A catalog is a configuration: it comes to the driver, up to MOST_RATES rates."""
    held = catalog.limit(MOST_RATES + 1).collect()
    if len(held) > MOST_RATES:
        raise ValueError(f"the catalog has more than {MOST_RATES} rates")
    entries: dict[str, dict[str, float]] = {}
    for row in held:
        entries.setdefault(row["model"], {})[row["field"]] = row["rate"]

    def found(name: str) -> str | None:
        tries = [name]
        for p in PREFIXES:
            tries += [p + name, name[len(p) :] if name.startswith(p) else None]
        return next((t for t in [*tries, name[:-9] if re.match(DATED, name) else None] if t in entries), None)

    known = set(entries)
    for p in PREFIXES:
        known |= {p + e for e in entries} | {e[len(p) :] for e in entries if e.startswith(p)}
    names = {n: (n, "catalog|" + e, e, "catalog", False) for n in known if (e := found(n))}
    rates = [x for e, r in entries.items() for x in _rate_rows("catalog|" + e, "catalog", r)]
    for model, terminal, kind, display, own in resolved_rules(rules):
        entry = None if kind in ("free", "custom") else found(terminal)
        kind = kind if kind in ("free", "custom") else "alias" if entry and kind == "alias" else "catalog" if entry else "none"
        names[model] = (model, f"{kind}|{entry or model}", display or entry or model, kind, True)
        if kind == "custom":
            rates += _rate_rows(f"custom|{model}", kind, own)
        elif kind == "alias":
            rates += _rate_rows(f"alias|{entry}", kind, entries[entry])
    rates = list({r[:3]: r for r in rates}.values())
    spark = catalog.sparkSession
    return Prices(
        spark.createDataFrame(list(names.values()), "raw_model string, entry string, model string, kind string, ruled boolean"),
        spark.createDataFrame(rates, "entry string, tier_key string, band int, rated boolean, tiered boolean, r0 double, r1 double, r2 double, r3 double, r4 double"),
    )


_TIER_KEY = "CASE " + " ".join(f"WHEN lower(trim(coalesce(service_tier, ''))) IN ({', '.join(repr(k) for k, v in TIERS.items() if v == t)}) THEN '{t}'" for t in KNOWN_TIERS[:-1]) + f" ELSE '{OTHER_TIER}' END"
_PROMPT = "(input_tokens + cache_read_tokens + cache_write_tokens)"
_BAND = "CASE " + " ".join(f"WHEN {_PROMPT} > {n} THEN {len(CONTEXTS) - i}" for i, (n, _) in enumerate(CONTEXTS)) + " ELSE 0 END"
_HOUR = "least(greatest(coalesce(cache_write_1h_tokens, 0), 0), cache_write_tokens)"
#: Cost of each kind of token; null as soon as there are tokens without a rate.
_AMOUNTS = {f"a{i}": f"CASE WHEN {n} > 0 THEN {n} * r{i} ELSE 0D END" for i, n in enumerate(("input_tokens", "output_tokens", "cache_read_tokens", f"(cache_write_tokens - {_HOUR})", _HOUR))}
_META = "(kind = 'custom' OR service_tier IS NOT NULL) AND (cache_write_tokens = 0 OR cache_write_1h_tokens IS NOT NULL)"
_MISSING = " | ".join(f"CASE WHEN a{i} IS NULL THEN {GAP[n]} ELSE 0 END" for i, n in enumerate(("input", "output", "read", "write", "write_1h")))


def priced(events: DataFrame, prices: Prices) -> DataFrame:
    """events with model, cost_usd, cost_known, parts (cost of input, output, read and write; null where the cost
    can't be explained by rates) and gaps (bits of what a price lacks, for rows without a known cost)."""
    dated, plain = f"raw_model RLIKE '{DATED}'", "substring(raw_model, 1, length(raw_model) - 9)"
    kept = [c for c in events.columns if c not in ("cost_usd", "cost_known", "model")]
    names = prices.names.withColumnsRenamed({"entry": "_entry", "model": "_model", "kind": "_kind"})
    df = events.drop("model").join(F.broadcast(names), "raw_model", "left").selectExpr(
        "*", f"coalesce(_entry, CASE WHEN {dated} THEN concat('catalog|', {plain}) END) AS entry", f"{_TIER_KEY} AS tier_key", f"{_BAND} AS band"
    )
    df = df.join(F.broadcast(prices.rates), ["entry", "tier_key", "band"], "left").selectExpr(
        "*", f"coalesce(_model, CASE WHEN rated IS NOT NULL THEN {plain} END, raw_model) AS model", "coalesce(_kind, CASE WHEN rated IS NOT NULL THEN 'catalog' END, 'none') AS kind",
        "harness = 'grok' AND NOT coalesce(ruled, false) AS native", *[f"{x} AS {n}" for n, x in _AMOUNTS.items()],
    )
    df = df.selectExpr("*", "CASE WHEN rated THEN a0 + a1 + a2 + a3 + a4 END AS total", f"{_META} AS meta", f"kind = 'free' OR ({_META}) OR (kind IN ('custom', 'alias') AND NOT cost_known) AS estimable")
    df = df.selectExpr(
        "*",
        """CASE WHEN native THEN CASE WHEN reported_cost_usd > 0 THEN reported_cost_usd END
        WHEN estimable THEN CASE WHEN kind = 'free' THEN 0D WHEN total < double('infinity') THEN total END WHEN cost_known THEN cost_usd END AS cost""",
    )
    near = "abs(total - cost) <= 1.7763568394002505e-15 * greatest(abs(total), abs(cost))"  # eight times the precision of a double
    explained = f"NOT native AND CASE WHEN kind = 'free' THEN cost = 0 ELSE kind <> 'none' AND (kind IN ('custom', 'alias') OR meta) AND {near} END"
    part = lambda x: f"CASE WHEN kind = 'free' THEN 0D ELSE {x} END"
    gaps = f"""CASE WHEN native THEN {GAP["reported"]} WHEN kind = 'none' THEN {GAP["price"]} WHEN kind = 'free' THEN 0 WHEN NOT estimable THEN {GAP["metadata"]} WHEN NOT coalesce(rated, false) THEN {GAP["tier"]}
        ELSE ({_MISSING}) | CASE WHEN kind = 'catalog' AND tiered AND ({_MISSING}) > 0 THEN {GAP["tier"]} ELSE 0 END END"""
    return df.selectExpr(
        *kept, "model", "coalesce(cost, 0D) AS cost_usd", "cost IS NOT NULL AS cost_known",
        f"CASE WHEN {explained} THEN struct({part('a0')} AS input, {part('a1')} AS output, {part('a2')} AS read, {part('a3 + a4')} AS write) END AS parts",
        f"CASE WHEN cost IS NULL THEN {gaps} ELSE 0 END AS gaps",
    )


# Texts of the flags.
GAP_TEXT = {1: "no price", 2: "no reported cost", 4: "no cache or tier details", 8: "no rate for the service tier", 16: "no input rate", 32: "no output rate", 64: "no cache read rate", 128: "no cache write rate", 256: "no one-hour cache write rate"}


def describe_gaps(gaps: int) -> str:
    return ", ".join(text for bit, text in GAP_TEXT.items() if gaps & bit)
