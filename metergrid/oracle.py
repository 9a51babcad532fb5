"""DuckDB SQL of the registered queries, written independently of the DataFrame code but for the events' SELECT."""

from __future__ import annotations

from datetime import datetime

from metergrid.workload import CATALOG, LOCAL_DEVICE, NOW, events_sql

# Fixed values, written out here so that those of the code are checked: dimensions, sums, name prefixes, tiers, prompt sizes,
# providers of namespaces and of families.
DIMENSIONS = {"harness": "harness", "model": "model", "provider": "provider", "project": "project_key", "device": "device"}
SUMS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens")
PREFIXES = ("openai/", "anthropic/", "xai/", "meta/")
TIERS = {"": "", "default": "", "standard": "", "priority": "_priority", "fast": "_priority", "ultrafast": "_ultrafast", "flex": "_flex", "batch": "_batches", "batches": "_batches"}
CONTEXTS = ((272_000, "_above_272k_tokens"), (200_000, "_above_200k_tokens"))
NAMESPACES = {
    "openai": "openai", "anthropic": "anthropic", "xai": "xai", "x-ai": "xai", "google": "google", "gemini": "google", "google_genai": "google", "vertex_ai": "google", "vertex-ai": "google", "deepseek": "deepseek",
    "meta": "meta", "meta-llama": "meta", "openrouter": "openrouter", "azure": "azure",
}
FAMILIES = [
    ("openai", ("gpt-", "chatgpt-", "o1-", "o3-", "o4-", "codex-mini-")), ("anthropic", ("claude-",)), ("google", ("gemini-", "gemma-")), ("xai", ("grok-",)), ("deepseek", ("deepseek-",)), ("alibaba", ("qwen",)),
    ("meta", ("llama-", "llama2-", "llama3-", "llama4-", "muse-")), ("moonshot", ("kimi-", "moonshot-")), ("zai", ("glm-",)),
]
NOW_MS = int(datetime.fromisoformat(NOW).timestamp() * 1000)
TOTAL = "(input_tokens + output_tokens + cache_read_tokens + cache_write_tokens)"
DEV = "coalesce(device_id, 'local')"


def _text(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def _provider(m: str) -> str:
    name = f"lower(trim({m}))"
    space = " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in NAMESPACES.items())
    family = " ".join("WHEN " + " OR ".join(f"starts_with({name}, {_text(x)})" for x in starts) + f" THEN {_text(who)}" for who, starts in FAMILIES)
    return f"CASE WHEN contains({name}, '/') THEN CASE split_part({name}, '/', 1) {space} ELSE 'unknown' END WHEN {name} IN ('o1', 'o3', 'o4') THEN 'openai' {family} ELSE 'unknown' END"


def owned(devices: tuple[str, ...] | None = None, dedup: bool = True) -> str:
    kept = "" if devices is None else f"WHERE {DEV} IN ({', '.join(map(_text, devices))})"
    one = f"QUALIFY row_number() OVER (PARTITION BY harness, id ORDER BY {TOTAL} DESC, {DEV} <> '{LOCAL_DEVICE}', {DEV}) = 1" if dedup else ""
    return f"ev AS ({events_sql('duckdb')}), own AS (SELECT * FROM ev {kept} {one})"


def priced(devices: tuple[str, ...] | None = None, dedup: bool = True) -> str:
    """CTEs that end in p: priced rows with all keys."""
    tries = ["(0, terminal)"]
    for i, x in enumerate(PREFIXES):
        tries += [f"({2 * i + 1}, {_text(x)} || terminal)", f"({2 * i + 2}, CASE WHEN starts_with(terminal, {_text(x)}) THEN substr(terminal, {len(x) + 1}) END)"]
    tries.append(r"(99, CASE WHEN regexp_matches(terminal, '^claude-.*-\d{8}$') THEN regexp_replace(terminal, '-\d{8}$', '') END)")
    values = ", ".join(f"({_text(m)}, {_text(f)}, CAST({r!r} AS DOUBLE))" for m, f, r in CATALOG)
    tiers = " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in TIERS.items())
    one = lambda key: f"list_filter(rates, lambda x: x.field = {key})[1].rate"
    fields = {"i": "input_cost_per_token", "o": "output_cost_per_token", "r": "cache_read_input_token_cost", "w": "cache_creation_input_token_cost", "h": "cache_creation_input_token_cost_above_1hr"}
    context = "CASE " + " ".join(f"WHEN prompt > {n} AND {one(_text(fields['i'] + s))} IS NOT NULL THEN {_text(s)}" for n, s in CONTEXTS) + " ELSE '' END"
    rate = lambda f, tier: f"coalesce({one(f'{_text(f)} || ctx || {tier}')}, {one(f'{_text(f)} || {tier}')})"
    rates = ", ".join(f"{rate(f, 'tier')} AS {k}_own, {rate(f, _text(''))} AS {k}_std" for k, f in fields.items())
    f = "kind IN ('custom', 'alias')"
    return f"""{owned(devices, dedup)},
cat(model, field, rate) AS (VALUES {values}),
entry AS (SELECT model AS entry, list({{'field': field, 'rate': rate}}) AS rates FROM cat GROUP BY model),
name AS (SELECT DISTINCT raw_model, CASE raw_model WHEN 'house-alias' THEN 'grok-4.6' ELSE raw_model END AS terminal FROM own),
try AS (SELECT raw_model, unnest([{", ".join(f"{{'turn': {x[1:].split(',', 1)[0]}, 'name': {x.split(',', 1)[1][:-1]}}}" for x in tries)}]) AS t FROM name WHERE raw_model NOT IN ('house-free', 'house-custom')),
hit AS (SELECT raw_model, entry, rates FROM try JOIN entry ON entry = t.name QUALIFY row_number() OVER (PARTITION BY raw_model ORDER BY t.turn) = 1),
res AS (
  SELECT name.raw_model, CASE name.raw_model WHEN 'house-free' THEN 'free' WHEN 'house-custom' THEN 'custom' ELSE CASE WHEN entry IS NULL THEN 'none' WHEN name.raw_model = 'house-alias' THEN 'alias' ELSE 'catalog' END END AS kind,
    CASE name.raw_model WHEN 'house-custom' THEN 'house-custom-v2' ELSE coalesce(entry, name.raw_model) END AS model, starts_with(name.raw_model, 'house-') AS ruled,
    CASE name.raw_model WHEN 'house-custom' THEN [{{'field': '{fields["i"]}', 'rate': CAST(2.0 AS DOUBLE) / 1e6}}, {{'field': '{fields["o"]}', 'rate': CAST(8.0 AS DOUBLE) / 1e6}}, {{'field': '{fields["r"]}', 'rate': CAST(0.2 AS DOUBLE) / 1e6}}] ELSE rates END AS rates
  FROM name LEFT JOIN hit USING (raw_model)),
c1 AS (SELECT own.*, res.model, kind, ruled, rates, input_tokens + cache_read_tokens + cache_write_tokens AS prompt,
  CASE WHEN kind = 'custom' THEN '' ELSE CASE lower(trim(coalesce(service_tier, ''))) {tiers} ELSE CASE WHEN kind = 'alias' THEN '' END END END AS tier,
  least(greatest(coalesce(cache_write_1h_tokens, 0), 0), cache_write_tokens) AS n_h FROM own LEFT JOIN res USING (raw_model)),
c2 AS (SELECT *, {context} AS ctx, cache_write_tokens - n_h AS n_w FROM c1),
c3 AS (SELECT *, {rates} FROM c2),
c4 AS (SELECT *, CASE WHEN {f} THEN coalesce(i_own, i_std) ELSE i_own END AS r_i, CASE WHEN {f} THEN coalesce(o_own, o_std) ELSE o_own END AS r_o FROM c3),
c5 AS (SELECT *, CASE WHEN kind = 'alias' THEN coalesce(r_own, r_std, r_i) WHEN kind = 'custom' THEN coalesce(r_own, r_std) ELSE r_own END AS r_r,
  CASE WHEN kind = 'alias' THEN coalesce(w_own, w_std, r_i) WHEN kind = 'custom' THEN coalesce(w_own, w_std) ELSE w_own END AS r_w,
  CASE WHEN kind = 'alias' THEN coalesce(h_own, w_own, h_std, w_std, r_i) WHEN kind = 'custom' THEN coalesce(h_own, w_own, h_std, w_std) ELSE h_own END AS r_h FROM c4),
c6 AS (SELECT *, CASE WHEN input_tokens > 0 THEN input_tokens * r_i ELSE 0.0 END AS a_i, CASE WHEN output_tokens > 0 THEN output_tokens * r_o ELSE 0.0 END AS a_o, CASE WHEN cache_read_tokens > 0 THEN cache_read_tokens * r_r ELSE 0.0 END AS a_r,
  CASE WHEN n_w > 0 THEN n_w * r_w ELSE 0.0 END AS a_w, CASE WHEN n_h > 0 THEN n_h * r_h ELSE 0.0 END AS a_h,
  (kind = 'custom' OR service_tier IS NOT NULL) AND (cache_write_tokens = 0 OR cache_write_1h_tokens IS NOT NULL) AS meta, harness = 'grok' AND NOT ruled AS native FROM c5),
c7 AS (SELECT *, CASE WHEN kind = 'free' THEN 0.0 WHEN tier IS NOT NULL AND rates IS NOT NULL THEN a_i + a_o + a_r + a_w + a_h END AS estimate, kind = 'free' OR meta OR kind IN ('custom', 'alias') AS estimable FROM c6),
c8 AS (SELECT *, CASE WHEN native THEN CASE WHEN reported_cost_usd > 0 THEN reported_cost_usd END WHEN estimable THEN estimate END AS cost FROM c7),
p AS (SELECT * EXCLUDE (cost_usd, cost_known), CAST(coalesce(cost, 0) AS DOUBLE) AS cost_usd, cost IS NOT NULL AS cost_known, {TOTAL} AS tokens, coalesce(repository, project) AS project_key, {DEV} AS device,
  CASE WHEN session_id <> '' THEN {DEV} || ':' || harness || ':' || session_id END AS session_key, coalesce(requests, 1) AS request_count, {_provider("model")} AS provider,
  cost IS NOT NULL AND NOT native AND (kind = 'free' OR kind IN ('custom', 'alias') OR kind = 'catalog' AND meta) AND estimate IS NOT NULL AS explained,
  CASE WHEN cost IS NOT NULL THEN 0 WHEN native THEN 2 WHEN kind = 'none' THEN 1 WHEN NOT estimable THEN 4 WHEN tier IS NULL THEN 8 ELSE
    CASE WHEN a_i IS NULL THEN 16 ELSE 0 END + CASE WHEN a_o IS NULL THEN 32 ELSE 0 END + CASE WHEN a_r IS NULL THEN 64 ELSE 0 END + CASE WHEN a_w IS NULL THEN 128 ELSE 0 END + CASE WHEN a_h IS NULL THEN 256 ELSE 0 END
    + CASE WHEN kind = 'catalog' AND tier <> '' THEN 8 ELSE 0 END END AS gaps FROM c8)"""


COST = "round(coalesce(sum(cost_usd), 0), 9)"
UNPRICED = "CAST(coalesce(sum(tokens) FILTER (NOT cost_known), 0) AS BIGINT)"
MEASURES = f"CAST(sum(tokens) AS BIGINT) AS tokens, {COST} AS cost_usd, {UNPRICED} AS unpriced_tokens"
TOTALS = (
    "CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, " + ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in SUMS)
    + f", {COST} AS cost_usd, {UNPRICED} AS unpriced_tokens, count(DISTINCT session_key) AS sessions, CAST(coalesce(sum(request_count), 0) AS BIGINT) AS requests, "
    "round(coalesce(CAST(sum(cache_read_tokens) AS DOUBLE) / nullif(sum(input_tokens + cache_read_tokens + cache_write_tokens), 0), 0), 6) AS cache_hit_rate"
)


def _instant(wall: str, zone: str) -> str:
    return f"epoch_ms(timezone('{zone}', {wall}))"


def window(range_: str, zone: str = "UTC") -> tuple[str, str, str, str]:
    """SQL of start, end, previous start and the first instant of today."""
    wall = f"timezone('{zone}', TIMESTAMPTZ '{NOW}')"
    midnight = f"date_trunc('day', {wall})"
    today, end = _instant(midnight, zone), _instant(f"{midnight} + INTERVAL 1 DAY", zone)
    if range_ == "today":
        return today, end, _instant(f"{midnight} - INTERVAL 1 DAY", zone), today
    if range_ == "6m":
        first = f"({midnight} + INTERVAL 1 DAY - INTERVAL 6 MONTH)"
        return _instant(first, zone), end, _instant(f"{first} - INTERVAL 6 MONTH", zone), today
    if range_ == "all":
        oldest = f"(SELECT least(min(ms), {NOW_MS}) FROM ev)"
        return _instant(f"date_trunc('day', timezone('{zone}', to_timestamp({oldest} / 1000)))", zone), end, "NULL", today
    n = int(range_[:-1])
    return _instant(f"{wall} - INTERVAL {n} DAY", zone), end, _instant(f"{wall} - INTERVAL {2 * n} DAY", zone), today


def chosen(range_: str = "30d", zone: str = "UTC", where: str = "true", devices: tuple[str, ...] | None = None, previous: bool = False) -> str:
    start, end, before, _ = window(range_, zone)
    low, high = (before, start) if previous else (start, end)
    return f"WITH {priced(devices)}, s AS (SELECT * FROM p WHERE ms >= {low} AND ms < {high} AND ms <= {NOW_MS} AND ({where}))"


def _day(zone: str) -> str:
    return f"CAST(timezone('{zone}', timezone('UTC', ts)) AS DATE)"


def _daily(zone: str, range_: str = "30d") -> str:
    start, _, _, today = window(range_, zone)
    return f"""{chosen(range_, zone)},
calendar AS (SELECT CAST(unnest(generate_series(date_trunc('day', timezone('{zone}', to_timestamp({start} / 1000))), date_trunc('day', timezone('{zone}', TIMESTAMPTZ '{NOW}')), INTERVAL 1 DAY)) AS DATE) AS day),
d AS (SELECT {_day(zone)} AS day, {MEASURES} FROM s GROUP BY 1),
days AS (SELECT day, coalesce(tokens, 0) AS tokens, coalesce(cost_usd, 0.0) AS cost_usd, coalesce(unpriced_tokens, 0) AS unpriced_tokens FROM calendar LEFT JOIN d USING (day))"""


def _hourly(zone: str) -> str:
    _, end, _, today = window("today", zone)
    return f"""{chosen("today", zone)},
hours AS (SELECT CAST(row_number() OVER (ORDER BY first_ms) - 1 AS INTEGER) AS hour, first_ms FROM (SELECT unnest(generate_series({today}, {end} - 1, 3600000)) AS first_ms)),
h AS (SELECT CAST((ms - {today}) // 3600000 AS INTEGER) AS hour, {MEASURES} FROM s GROUP BY 1)
SELECT hour, first_ms, coalesce(tokens, 0) AS tokens, coalesce(cost_usd, 0.0) AS cost_usd, coalesce(unpriced_tokens, 0) AS unpriced_tokens FROM hours LEFT JOIN h USING (hour)"""


def _by(column: str) -> str:
    return f"{chosen()} SELECT *, CAST(row_number() OVER (ORDER BY tokens DESC, name) AS INTEGER) AS rank FROM (SELECT {column} AS name, {TOTALS} FROM s GROUP BY 1)"


ROUND_COST = "CASE WHEN abs(cost_usd) >= 0.001 THEN floor(cost_usd * 1e6 + 0.5) / 1e6 WHEN cost_usd = 0 THEN 0 ELSE floor(cost_usd * pow(10, 5 - floor(log10(abs(cost_usd)))) + 0.5) / pow(10, 5 - floor(log10(abs(cost_usd)))) END"
ORDER = "(ms, id, device)"


def _newest(column: str) -> str:
    return f"arg_max(nullif(trim({column}), ''), {ORDER}) FILTER (nullif(trim({column}), '') IS NOT NULL) AS {column}"


SESSIONS = f"""{chosen()}, sess AS (SELECT device, harness, session_id, arg_min(project, {ORDER}) AS project, (arg_min({{'r': repository}}, {ORDER})).r AS repository, min(ms) AS started_ms, max(ms) AS last_active_ms,
  string_agg(DISTINCT model, ', ' ORDER BY model) AS model, string_agg(DISTINCT provider, ', ' ORDER BY provider) AS provider, {_newest("session_title")}, {_newest("project_name")},
  arg_max({{'i': thread_id, 'u': thread_url}}, {ORDER}) FILTER (coalesce(thread_id, '') <> '' OR coalesce(thread_url, '') <> '') AS thread, {TOTALS} FROM s WHERE session_id <> '' GROUP BY 1, 2, 3),
sessions_ AS (SELECT * EXCLUDE (thread, sessions), thread.i AS thread_id, thread.u AS thread_url FROM sess)"""


def _page(key: str, number: int) -> str:
    order = f"{key} DESC, last_active_ms DESC, session_id, device, harness"
    return f"""{SESSIONS} SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank, session_id, device, harness, tokens, cost_usd, last_active_ms FROM sessions_) WHERE rank > {12 * (number - 1)} AND rank <= {12 * number}"""


def _facets(devices: tuple[str, ...] | None) -> str:
    kept = "true" if devices is None else f"device IN ({', '.join(map(_text, devices))})"
    parts = " UNION ALL ".join(f"SELECT '{n}' AS facet, {c} AS value FROM p WHERE {'true' if n == 'device' else kept}" for n, c in DIMENSIONS.items())
    return f"WITH {priced(dedup=False)} SELECT DISTINCT facet, value FROM ({parts}) WHERE value IS NOT NULL"


INCOMING = """inc AS (SELECT * REPLACE (input_tokens + CASE WHEN event_id % 18 = 0 THEN 100 ELSE 0 END AS input_tokens, CASE WHEN event_id % 27 <> 0 THEN session_title END AS session_title,
  CASE WHEN event_id % 27 <> 0 THEN service_tier END AS service_tier, CASE WHEN event_id % 4 <> 0 THEN repository END AS repository, CASE WHEN event_id % 45 = 0 THEN concat('n:', CAST(event_id AS VARCHAR)) ELSE id END AS id)
  FROM ev WHERE event_id % 9 = 0 AND device_id <> 'dev-copy')"""
EV = f"ev AS ({events_sql('duckdb')})"

#: The stored rows after the upload and the withdrawal of every fortieth event.
STORED = f"""{EV.replace("ev AS (", "ev0 AS (", 1)}, {INCOMING.replace("FROM ev WHERE", "FROM ev0 WHERE")},
ev AS (SELECT * FROM (SELECT * FROM ev0 ANTI JOIN inc USING (device_id, id) UNION ALL BY NAME SELECT * FROM inc) ANTI JOIN (SELECT device_id, id FROM ev0 WHERE event_id % 40 = 0) USING (device_id, id))"""

FILES = """f AS (SELECT CAST(c_custkey AS VARCHAR) AS session_id, CASE WHEN c_custkey >= 7 THEN CAST(c_custkey // 7 AS VARCHAR) END AS parent_id, CASE WHEN c_custkey % 5 = 0 THEN '/p/' || CAST(c_nationkey AS VARCHAR) END AS project, c_custkey * 10 AS forked_ms FROM customer),
up AS (SELECT session_id, parent_id AS ancestor, 1 AS distance FROM f WHERE parent_id IS NOT NULL UNION ALL SELECT up.session_id, f.parent_id, distance + 1 FROM up JOIN f ON f.session_id = up.ancestor WHERE f.parent_id IS NOT NULL AND distance < 16)"""

REMOTE = """CASE c_custkey % 6 WHEN 0 THEN 'github.com/org/repo' || c_custkey WHEN 1 THEN 'gitlab.com/a/b' || c_custkey WHEN 2 THEN 'host.example/Team/R' || c_custkey WHEN 3 THEN 'code.example/x/Y' || c_custkey END"""


def oracle_sql() -> dict[str, str]:
    found = {f"totals_{r}": f"{chosen(r)} SELECT {TOTALS} FROM s" for r in ("today", "7d", "30d", "90d", "6m", "all")}
    found["totals_7d_kathmandu"] = f"{chosen('7d', 'Asia/Kathmandu')} SELECT {TOTALS} FROM s"
    found["totals_previous_7d"] = f"{chosen('7d', previous=True)} SELECT {TOTALS} FROM s"
    found |= {f"by_{d}": _by(c) for d, c in DIMENSIONS.items()}
    found |= {f"daily_by_{d}": f"{chosen()} SELECT {_day('UTC')} AS day, {c} AS name, {TOTALS if d == 'harness' else MEASURES} FROM s GROUP BY 1, 2" for d, c in DIMENSIONS.items()}
    found["daily_zero_filled"] = _daily("UTC") + " SELECT * FROM days"
    found["daily_zero_filled_new_york"] = _daily("America/New_York") + " SELECT * FROM days"
    found |= {"hourly_today_utc": _hourly("UTC"), "hourly_today_kathmandu": _hourly("Asia/Kathmandu")}
    found["weekly_90d"] = f"""{_daily("UTC", "90d")} SELECT min(day) AS first, CASE WHEN max(day) > min(day) THEN max(day) END AS last, CAST(sum(tokens) AS BIGINT) AS tokens, {COST} AS cost_usd, CAST(sum(unpriced_tokens) AS BIGINT) AS unpriced_tokens
FROM days GROUP BY date_trunc('week', day)"""
    keys = lambda *v: "(project_key IN ({0}) OR project IN ({0}))".format(", ".join(map(_text, v)))
    wheres = {
        "filter_include": keys("github.com/org/r1", "/work/p12"), "filter_empty_list": "false", "filter_provider": "provider IN ('openai', 'google')",
        "filter_raw_models": "model IN (SELECT model FROM p WHERE raw_model IN ('xai/grok-4.6', 'house-custom', 'claude-fable-5-1-20260101', 'quasar-alpha'))",
        "filter_project_exclude_wins": f"{keys('github.com/org/r1', 'github.com/org/r2')} AND NOT {keys('github.com/org/r1')}",
    }
    found |= {n: f"{chosen(where=w)} SELECT {TOTALS} FROM s" for n, w in wheres.items()}
    found["filter_multi_dimension"] = f"{chosen(where=_text('x') + ' = ' + _text('x') + ' AND harness IN (' + _text('claude') + ', ' + _text('codex') + ')', devices=('dev-1', 'dev-copy'))} SELECT {TOTALS} FROM s"
    pick = f"SELECT id, harness, {DEV} AS device, ms, {TOTAL} AS tokens FROM own"
    found |= {"owner_dedup": f"WITH {owned()} {pick}", "owner_dedup_device_filter": f"WITH {owned(('dev-1', 'dev-copy'))} {pick}"}
    found["cross_window_owner"] = f"WITH {EV} SELECT harness, id, count(*) AS copies FROM ev GROUP BY 1, 2 HAVING count(DISTINCT ms) > 1"
    found |= {"sessions": SESSIONS + " SELECT * FROM sessions_", "sessions_page2": _page("last_active_ms", 2), "sessions_by_cost": _page("cost_usd", 1), "facets": _facets(None), "facets_of_device": _facets(("dev-1",))}
    found["marginals"] = f"{chosen()} " + " UNION ALL ".join(f"SELECT '{n}' AS dimension, {c} AS name, {TOTALS} FROM s GROUP BY {c}" for n, c in DIMENSIONS.items()) + f" UNION ALL SELECT 'total', '', {TOTALS} FROM s"
    found["project_insights"] = f"""{chosen()} SELECT project_key AS name, {TOTALS}, string_agg(DISTINCT project, chr(10) ORDER BY project) AS paths,
  coalesce(string_agg(DISTINCT nullif(trim(project_name), ''), chr(10) ORDER BY nullif(trim(project_name), '')), '') AS project_names, max(ms) AS last_active_ms FROM s GROUP BY 1"""
    found["dimension_counts"] = f"WITH {EV} SELECT {DEV} AS device, harness, raw_model AS model, coalesce(repository, project) AS project, count(*) AS records FROM ev GROUP BY 1, 2, 3, 4"
    found["model_resolution"] = f"WITH {priced()} SELECT raw_model, model, kind, ruled, CAST(coalesce(len(rates), 0) AS INTEGER) AS n_rates FROM res"
    part = lambda *c: "CASE WHEN explained THEN round(CASE WHEN kind = 'free' THEN 0 ELSE " + " + ".join(c) + " END, 9) END"
    found["reprice"] = f"WITH {priced()} SELECT harness, id, model, round(cost_usd, 9) AS cost_usd, cost_known, gaps, {part('a_i')} AS input_usd, {part('a_o')} AS output_usd, {part('a_r')} AS read_usd, {part('a_w', 'a_h')} AS write_usd FROM p"
    kinds = {"input": ("a_i", "input_tokens"), "output": ("a_o", "output_tokens"), "read": ("a_r", "cache_read_tokens"), "write": ("a_w + a_h", "cache_write_tokens")}
    found["cost_parts"] = f"{chosen()} SELECT " + ", ".join(
        f"round(coalesce(sum({a}) FILTER (explained AND kind <> 'free'), 0), 9) AS {n}_usd, CAST(coalesce(sum({t}) FILTER (NOT explained), 0) AS BIGINT) AS {n}_unavailable" for n, (a, t) in kinds.items()
    ) + ", round(coalesce(sum(cost_usd) FILTER (NOT explained AND cost_known), 0), 9) AS unattributed_usd FROM s"
    found["unresolved_pricing"] = f"""{chosen()} SELECT *, CAST(row_number() OVER (ORDER BY tokens DESC, raw_model) AS INTEGER) AS rank FROM (SELECT raw_model, CAST(sum(tokens) AS BIGINT) AS tokens, bit_or(gaps) AS gaps,
  string_agg(DISTINCT coalesce(service_tier, ''), ',' ORDER BY coalesce(service_tier, '')) AS tiers FROM s WHERE NOT cost_known AND tokens > 0 GROUP BY 1)"""
    found["top10_union"] = f"""{chosen()}, g AS (SELECT project_key AS name, {MEASURES} FROM s GROUP BY 1)
SELECT * FROM (SELECT name, tokens, cost_usd, CAST(row_number() OVER (ORDER BY tokens DESC, name) AS INTEGER) AS by_tokens, CAST(row_number() OVER (ORDER BY {ROUND_COST} DESC, tokens DESC, name) AS INTEGER) AS by_cost, count(*) OVER () AS total_count FROM g) WHERE by_tokens <= 5 OR by_cost <= 5"""
    found["series_arrays"] = f"""{_daily("UTC")}, cell AS (SELECT {_day("UTC")} AS day, model AS name, {MEASURES} FROM s GROUP BY 1, 2),
grid AS (SELECT name, day, coalesce(cell.tokens, 0) AS t, coalesce(cell.cost_usd, 0) AS cost_usd, coalesce(cell.unpriced_tokens, 0) AS u FROM (SELECT DISTINCT name FROM cell) CROSS JOIN (SELECT day FROM days) LEFT JOIN cell USING (name, day))
SELECT name, string_agg(CAST(t AS VARCHAR), ',' ORDER BY day) AS t, CAST(count(*) AS INTEGER) AS n_c, round(sum({ROUND_COST}), 4) AS c_sum, CASE WHEN max(u) > 0 THEN string_agg(CAST(u AS VARCHAR), ',' ORDER BY day) END AS u FROM grid GROUP BY name"""
    found["bucket_other"] = f"""{chosen()}, cell AS (SELECT {_day("UTC")} AS day, project_key AS name, {MEASURES} FROM s GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY day ORDER BY tokens DESC, name) AS INTEGER) AS rank, row_number() OVER (PARTITION BY day ORDER BY {ROUND_COST} DESC, name) AS cr FROM cell),
o AS (SELECT day, CAST(coalesce(sum(tokens) FILTER (rank > 4), 0) AS BIGINT) AS other_tokens, round(coalesce(sum(cost_usd) FILTER (cr > 4), 0), 9) AS other_cost FROM r GROUP BY day)
SELECT r.* EXCLUDE (cr), other_tokens, other_cost FROM r JOIN o USING (day) WHERE rank <= 4 OR cr <= 4"""
    found["share_of_total"] = f"""{chosen()}, g AS (SELECT model AS name, CAST(sum(tokens) AS BIGINT) AS tokens FROM s GROUP BY 1), w AS (SELECT *, tokens / sum(tokens) OVER () AS x FROM g)
SELECT name, tokens, round(x, 6) AS share, CASE WHEN x > 0 AND x < 0.01 THEN '<1%' ELSE CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR) || '%' END AS share_text FROM w"""
    start, end, before, _ = window("7d")
    found["period_delta"] = f"""WITH {priced()}, g AS (SELECT model AS name, CAST(coalesce(sum(tokens) FILTER (ms >= {start}), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(tokens) FILTER (ms < {start}), 0) AS BIGINT) AS previous
  FROM p WHERE ms >= {before} AND ms < {end} AND ms <= {NOW_MS} GROUP BY 1), c AS (SELECT *, CAST(round((tokens - previous) / nullif(previous, 0) * 100) AS BIGINT) AS x FROM g)
SELECT name, tokens, previous, CASE WHEN previous = 0 AND tokens = 0 THEN '0%' WHEN previous = 0 THEN 'new' ELSE CAST(abs(x) AS VARCHAR) || '%' END AS delta,
  CASE WHEN tokens > previous THEN 'up' WHEN tokens < previous THEN 'down' ELSE 'flat' END AS direction FROM c"""
    found["counter_delta_reset"] = """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
c AS (SELECT l_orderkey, l_linenumber, CAST(sum(q) OVER w AS BIGINT) AS input, CAST(sum(2 * q) OVER w AS BIGINT) AS output, CAST(sum(3 * q) OVER w AS BIGINT) AS total FROM l WINDOW w AS (PARTITION BY l_orderkey, (l_linenumber - 1) // 4 ORDER BY l_linenumber)),
b AS (SELECT *, lag(input) OVER w AS pi, lag(output) OVER w AS po, lag(total) OVER w AS pt FROM c WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)), r AS (SELECT *, pi IS NULL OR input < pi OR output < po OR total < pt AS reset FROM b)
SELECT l_orderkey, l_linenumber, input, output, total, CASE WHEN reset THEN input ELSE greatest(0, input - pi) END AS input_delta, CASE WHEN reset THEN output ELSE greatest(0, output - po) END AS output_delta, CASE WHEN reset THEN total ELSE greatest(0, total - pt) END AS total_delta FROM r"""
    found["carry_forward_model"] = "SELECT conv_id, turn, role, last_value(CASE WHEN turn % 3 = 0 THEN 'm' || CAST(turn AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS model FROM conversations"
    found["parent_project_inherit"] = f"WITH RECURSIVE {FILES}, n AS (SELECT up.session_id, arg_min(f.project, distance) AS project FROM up JOIN f ON f.session_id = ancestor WHERE f.project IS NOT NULL GROUP BY 1) SELECT f.session_id, coalesce(f.project, n.project) AS project FROM f LEFT JOIN n USING (session_id)"
    found["fork_owner"] = f"""WITH RECURSIVE {FILES}, r AS (SELECT CAST(o_custkey AS VARCHAR) AS session_id, CAST(o_orderkey % 3 AS VARCHAR) AS native_id, o_orderkey % 5000 AS ms FROM orders),
h AS (SELECT up.session_id, native_id, arg_max(ancestor, distance) AS first FROM up JOIN (SELECT DISTINCT session_id AS ancestor, native_id FROM r) USING (ancestor) GROUP BY 1, 2)
SELECT session_id, native_id, CASE WHEN first IS NOT NULL AND (forked_ms IS NULL OR ms <= forked_ms) THEN first ELSE session_id END AS owner, count(*) AS n FROM r LEFT JOIN h USING (session_id, native_id) LEFT JOIN f USING (session_id) GROUP BY 1, 2, 3"""
    found["claude_sidechain_filter"] = """WITH r AS (SELECT l_orderkey || '-' || l_linenumber AS id, CASE WHEN l_linenumber % 5 <> 4 THEN l_orderkey END AS native, l_linenumber % 3 <> 1 AS sidechain, CAST(l_quantity AS BIGINT) % 4 AS input_tokens FROM lineitem),
o AS (SELECT native FROM r WHERE NOT sidechain AND native IS NOT NULL GROUP BY native HAVING count(DISTINCT id) = 1 AND max(input_tokens) > 0) SELECT id, sidechain, input_tokens FROM r WHERE NOT sidechain OR native IS NULL OR native NOT IN (SELECT native FROM o)"""
    found["merge_preserve_metadata"] = f"""WITH {EV}, {INCOMING}, j AS (SELECT i.*, e.event_id IS NOT NULL AS there, e.ms AS old_ms, e.input_tokens AS e_in, e.session_title AS e_title, e.service_tier AS e_tier, e.repository AS e_repo FROM inc i LEFT JOIN ev e USING (device_id, id)),
k AS (SELECT * REPLACE (coalesce(session_title, e_title) AS session_title) FROM j)
SELECT device_id, id, CASE WHEN NOT there THEN 'insert' WHEN (input_tokens, session_title, service_tier, repository) IS NOT DISTINCT FROM (e_in, e_title, e_tier, e_repo) THEN 'skip' ELSE 'update' END AS action,
  old_ms, input_tokens, session_title, service_tier, repository, CAST(0 AS DOUBLE) AS cost_usd FROM k"""
    found["stored_totals_after_merge"] = _by("harness").replace(EV, STORED)
    found["stored_dimension_counts"] = found["dimension_counts"].replace(EV, STORED)
    found["changed_records"] = f"""WITH {EV}, {INCOMING}, j AS (SELECT i.*, e.event_id IS NOT NULL AS there, e.input_tokens AS a, e.session_title AS b, e.service_tier AS c, e.repository AS d FROM inc i LEFT JOIN (SELECT * FROM ev WHERE device_id <> 'dev-copy') e USING (id))
SELECT id, device_id, input_tokens, session_title FROM j WHERE NOT there OR (input_tokens, session_title, service_tier, repository) IS DISTINCT FROM (a, b, c, d)"""
    found["withdrawal_states"] = f"WITH {EV} SELECT device_id, id, CASE WHEN event_id % 40 = 0 THEN 'pending' WHEN event_id % 20 = 0 THEN 'restored' ELSE 'acknowledged' END AS state, event_id % 20 = 0 AS stored FROM ev WHERE event_id % 10 = 0 AND device_id <> 'dev-copy'"
    found["retractions"] = f"WITH {EV} SELECT DISTINCT id FROM ev WHERE event_id % 40 = 0 AND id NOT IN (SELECT id FROM ev WHERE device_id = 'dev-copy' AND event_id % 3 = 0)"
    found["import_missing"] = f"WITH {EV}, {INCOMING} SELECT device_id, id, input_tokens FROM inc ANTI JOIN ev USING (device_id, id)"
    over = "n >= 20 OR held + r.size + 1 > 5000"
    found["batch_assign"] = f"""WITH RECURSIVE {EV}, r AS (SELECT device_id, ms // 86400000 AS day, length(id) + 300 AS size, row_number() OVER (PARTITION BY device_id, ms // 86400000 ORDER BY ms, id) AS i FROM ev),
g(device_id, day, i, size, batch, n, held) AS (SELECT device_id, day, i, size, CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(size + 1 AS BIGINT) FROM r WHERE i = 1
  UNION ALL SELECT r.device_id, r.day, r.i, r.size, CASE WHEN {over} THEN batch + 1 ELSE batch END, CASE WHEN {over} THEN 1 ELSE n + 1 END, CASE WHEN {over} THEN r.size + 1 ELSE held + r.size + 1 END
  FROM g JOIN r ON r.device_id = g.device_id AND r.day = g.day AND r.i = g.i + 1)
SELECT device_id, day, batch, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM g GROUP BY 1, 2, 3"""
    found["billing_residual"] = """WITH r AS (SELECT l_orderkey AS agent, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS of_runs FROM lineitem GROUP BY 1)
SELECT o_orderkey AS agent, o_orderkey % 97 + 150 AS tokens, coalesce(of_runs, 0) AS of_runs, greatest(0, o_orderkey % 97 + 150 - coalesce(of_runs, 0)) AS residual FROM orders LEFT JOIN r ON agent = o_orderkey"""
    found["project_labels"] = f"""WITH {EV}, k AS (SELECT DISTINCT coalesce(CASE WHEN event_id % 3 = 0 THEN '/home/u' || project END, repository, project) AS key FROM ev),
q AS (SELECT key, list_filter(string_split(key, '/'), lambda x: x <> '') AS parts FROM k), d AS (SELECT key, parts, unnest(generate_series(2, len(parts))) AS depth FROM q), t AS (SELECT key, depth, array_to_string(parts[len(parts) - depth + 1:], '/') AS label FROM d),
a AS (SELECT key, arg_min(label, depth) AS label FROM t WHERE (label, depth) IN (SELECT (label, depth) FROM t GROUP BY label, depth HAVING count(*) = 1) GROUP BY key)
SELECT key, coalesce(a.label, key) AS label, array_to_string(parts[len(parts) - 1:], '/') AS short FROM q LEFT JOIN a USING (key)"""
    found["canonical_repository"] = f"SELECT c_custkey AS k, {REMOTE} AS repository FROM customer"
    values = ", ".join(f"({_text(m)})" for m in sorted({m for m, _, _ in CATALOG}))
    found["catalog_search"] = f"""WITH c(model) AS (VALUES {values}), n AS (SELECT model, lower(model) AS name, list_last(string_split(lower(model), '/')) AS base FROM c),
k AS (SELECT model, CAST(CASE WHEN name = 'g' THEN 0 WHEN base = 'g' THEN 1 WHEN name LIKE 'g%' THEN 2 WHEN base LIKE 'g%' THEN 3 WHEN name LIKE '%/g%' OR name LIKE '%-g%' THEN 4 WHEN base LIKE '%g%' THEN 5 WHEN name LIKE '%g%' THEN 6 END AS INTEGER) AS kind, CAST(len(string_split(name, '/')) AS INTEGER) AS segments, CAST(length(base) AS INTEGER) AS length FROM n)
SELECT *, CAST(row_number() OVER (ORDER BY kind, segments, length, model) AS INTEGER) AS rank FROM k WHERE kind IS NOT NULL"""
    found["csv_export_escape"] = """WITH v AS (SELECT c_custkey AS k, coalesce(CASE c_custkey % 4 WHEN 0 THEN '=' || c_name WHEN 1 THEN ' -' || c_name WHEN 2 THEN 'a"' || c_name END, '') AS v FROM customer)
SELECT k, '"' || replace(CASE WHEN regexp_matches(v, '^\\s*[=+@-]') THEN '''' || v ELSE v END, '"', '""') || '"' AS cell FROM v"""
    return found
