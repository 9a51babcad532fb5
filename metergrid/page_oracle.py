"""DuckDB SQL of the queries of pages, reports, devices and projects."""

from __future__ import annotations

from metergrid.oracle import DEV, EV, MEASURES, NOW_MS, ROUND_COST, SESSIONS, TOTAL, TOTALS, _by, _hourly, chosen, owned, priced, window

DEVICES = """dev AS (SELECT s_suppkey AS k, 'dev-' || s_suppkey AS id, 'Host ' || s_suppkey % 4 AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'linux' ELSE 'darwin' END AS platform, CASE WHEN s_suppkey % 3 = 0 THEN '1.2.0' END AS collector_version,
  s_suppkey * 1000 AS last_seen_ms, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey END AS revoked_ms, CASE WHEN s_suppkey % 2 = 1 THEN '2024-01-' || lpad(CAST(s_suppkey % 28 + 1 AS VARCHAR), 2, '0') END AS pricing_updated_at FROM supplier)"""
OF_DEVICES = {
    "device_counts": f"WITH {EV}, {DEVICES}, n AS (SELECT {DEV} AS id, count(*) AS n FROM ev GROUP BY 1) SELECT id, name, coalesce(n, 0) AS event_count FROM dev LEFT JOIN n USING (id)",
    "hub_info": f"WITH {DEVICES} SELECT count(*) AS devices, count(*) FILTER (revoked_ms IS NULL) AS active, max(pricing_updated_at) AS pricing_updated_at FROM dev",
    "device_register": f"""WITH {DEVICES} SELECT id, CASE WHEN k % 3 = 1 AND revoked_ms IS NULL THEN 'New ' || id ELSE name END AS name, CASE WHEN k % 3 = 1 AND revoked_ms IS NULL THEN 'windows' ELSE platform END AS platform,
  CASE WHEN k % 3 = 1 AND revoked_ms IS NULL AND k % 2 = 0 THEN '2.0' ELSE collector_version END AS collector_version, revoked_ms FROM dev
UNION ALL SELECT id || '-b', 'New ' || id, 'windows', CASE WHEN k % 2 = 0 THEN '2.0' END, NULL FROM dev WHERE k % 3 = 1""",
    "device_heartbeat": f"""WITH {DEVICES} SELECT id, name, CASE WHEN k % 2 = 0 THEN 'bsd' ELSE platform END AS platform, CASE WHEN k % 2 = 0 THEN last_seen_ms + 9 ELSE last_seen_ms END AS last_seen_ms, CASE WHEN k % 4 = 0 THEN '[]' END AS sources,
  CASE WHEN k % 4 = 0 THEN '2025-01-01' ELSE pricing_updated_at END AS pricing_updated_at, collector_version FROM dev""",
    "device_suffixes": f"""WITH {DEVICES}, t AS (SELECT name, id, unnest(generate_series(4, 12)) AS n FROM dev WHERE name IN (SELECT name FROM dev GROUP BY name HAVING count(*) > 1)), u AS (SELECT name, n FROM t GROUP BY name, n HAVING count(DISTINCT right(id, n)) = count(*)),
m AS (SELECT name, min(n) AS n FROM u GROUP BY name) SELECT id, right(id, n) AS suffix FROM t JOIN m USING (name, n)""",
}


def _search(query: str, sort: str) -> str:
    """Project search by its rules; the letters of a fuzzy match as a regular expression from every start."""
    fields = "([lower(label), lower(key)] || list_transform(paths, lambda x: lower(x)) || list_transform(names, lambda x: lower(x)))"
    base = "list_transform([key] || paths || names, lambda x: lower(coalesce(list_filter(string_split(x, '/'), lambda y: y <> '')[-1], x)))"
    score = ["0.0"]
    for t in query.split():
        literal = f"list_max(list_transform({fields}, lambda f, i: CASE WHEN f = '{t}' THEN 100 WHEN starts_with(f, '{t}') THEN 80 WHEN instr(f, '{t}') > 0 THEN 60 - least(instr(f, '{t}') - 1, 20) END + CASE WHEN i = 1 THEN 20 ELSE 0 END))"
        ways = "".join(f"[^{c}]*{c}" for c in t[1:])
        spans = f"list_transform(generate_series(1, length(f)), lambda p: CASE WHEN substr(f, p, 1) = '{t[0]}' THEN nullif(length(regexp_extract(substr(f, p), '^{t[0]}{ways}')), 0) END)"
        fuzzy = f"list_max(list_transform({base}, lambda f: list_max(list_transform(list_filter({spans}, lambda n: n <= {3 * len(t) + 1}), lambda n: 10 + {float(len(t))} / n))))" if len(t) >= 3 else "NULL"
        score.append(f"coalesce(CAST({literal} AS DOUBLE), {fuzzy})")
    whole = f"CASE WHEN len(list_filter({fields}, lambda f: contains(f, '{query}'))) > 0 THEN 50 ELSE 0 END" if query else "0"
    order = "" if sort == "name" else f"coalesce({sort}, -1) DESC, "
    return f"""{chosen()}, ins AS (SELECT project_key AS key, list_sort(list(DISTINCT project)) AS paths, list_sort(list(DISTINCT trim(project_name)) FILTER (trim(project_name) <> '')) AS names, CAST(sum(tokens) AS BIGINT) AS tokens, max(ms) AS last_active_ms FROM s GROUP BY 1),
k AS (SELECT DISTINCT coalesce(repository, project) AS key FROM ev), parts AS (SELECT key, list_filter(string_split(key, '/'), lambda x: x <> '') AS part FROM k), cut AS (SELECT key, unnest(generate_series(2, len(part))) AS d, part FROM parts), lab AS (SELECT key, d, array_to_string(part[len(part) - d + 1:], '/') AS label FROM cut),
best AS (SELECT key, arg_min(label, d) AS label FROM lab WHERE (label, d) IN (SELECT (label, d) FROM lab GROUP BY label, d HAVING count(*) = 1) GROUP BY key),
i AS (SELECT key, coalesce(label, key) AS label, coalesce(paths, []) AS paths, coalesce(names, []) AS names, tokens, last_active_ms FROM k LEFT JOIN best USING (key) LEFT JOIN ins USING (key)),
sc AS (SELECT *, {" + ".join(score)} + {whole} AS score FROM i)
SELECT CAST(row_number() OVER (ORDER BY score DESC, {order}label, key) AS INTEGER) AS rank, key, label, round(CAST(score AS DOUBLE), 6) AS score, tokens FROM sc WHERE score IS NOT NULL"""


def oracle_sql(core: dict[str, str]) -> dict[str, str]:
    """`core`: the SQL of the other queries, on some of which these build."""
    found = dict(OF_DEVICES)
    found |= {f"hourly_by_{d}": f"{chosen('today')} SELECT CAST((ms - {window('today')[3]}) // 3600000 AS INTEGER) AS hour, {d} AS name, {TOTALS if d == 'harness' else MEASURES} FROM s GROUP BY 1, 2" for d in ("harness", "model")}
    start, end, _, _ = window("7d")
    found["window_owner"] = f"WITH {owned()} SELECT id, harness, {DEV} AS device, ms, {TOTAL} AS tokens FROM own WHERE ms >= {start} AND ms < {end} AND ms <= {NOW_MS}"
    found["facet_pairs"] = f"WITH {priced(dedup=False)} SELECT DISTINCT model, provider FROM p"
    sort = lambda order: f"{SESSIONS} SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY {order}, last_active_ms DESC, session_id, device, harness) AS INTEGER) AS rank, session_id, device, harness FROM sessions_)"
    label = "array_to_string(list_filter(string_split(coalesce(repository, project), '/'), lambda x: x <> '')[-2:], '/')"
    padded = lambda c: f"array_to_string(list_transform(regexp_extract_all(lower({c}), '([0-9]+|[^0-9]+)'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p, 20, '0') ELSE p END), '')"
    keys = {"started": "started_ms DESC", "tokens": "tokens DESC", "project": padded(label), "model": padded("model"), "device": padded("device")}
    found |= {f"sessions_by_{k}": sort(o) + " WHERE rank <= 12" for k, o in keys.items()}
    found["sessions_last_page"] = sort("last_active_ms DESC") + " WHERE rank > (SELECT (count(*) - 1) // 12 * 12 FROM sessions_)"
    found["price_snapshots"] = f"WITH {priced()} SELECT CASE WHEN harness <> 'grok' THEN 'policy' WHEN event_id % 3 = 0 THEN '2023-12' ELSE 'unknown' END AS snapshot, count(*) AS records FROM p WHERE cost_known GROUP BY 1"

    def cell(x: str) -> str:
        text = f"coalesce(CAST({x} AS VARCHAR), '')"
        return rf"""chr(34) || replace(CASE WHEN regexp_matches({text}, '^\s*[=+@-]') THEN chr(39) || {text} ELSE {text} END, chr(34), chr(34) || chr(34)) || chr(34)"""

    exported = {
        "session": "session_id", "harness": "harness", "models": "model", "project": "project", "repository": "repository", "device": "coalesce(n.name, device)", "tokens": "tokens", "estimated_cost_usd": r"regexp_replace(CAST(CAST(round(cost_usd, 9) AS DECIMAL(30, 9)) AS VARCHAR), '\.?0+$', '')", "unpriced_tokens": "unpriced_tokens",
        "last_active": "strftime(epoch_ms(last_active_ms), '%Y-%m-%dT%H:%M:%S.%gZ')", "session_title": "session_title", "project_name": "project_name", "t3_thread_id": "thread_id", "t3_thread_url": "thread_url", "t3_native_thread_url": "''",
        "repository_url": "'https://' || repository", "cursor_agent_url": "CASE WHEN harness = 'cursor' THEN 'https://cursor.com/agents/' || session_id END",
    }
    found["session_export"] = f"{SESSIONS}, {DEVICES}, n AS (SELECT id, name FROM dev WHERE id <> 'dev-3') SELECT " + ", ".join(f"{cell(x)} AS {n}" for n, x in exported.items()) + " FROM sessions_ LEFT JOIN n ON n.id = device"
    line = "'  ' || rpad(name, 26, ' ') || ' ' || lpad(format('{:,}', tokens), 16, ' ') || ' tokens  ' || lpad('$' || format('{:,.2f}', cost_usd), 12, ' ')"
    of = lambda part, c, most: f"SELECT '{part}' AS part, place, {line} AS line FROM (SELECT *, CAST(row_number() OVER (ORDER BY tokens DESC, name) AS INTEGER) AS place FROM (SELECT {c} AS name, {MEASURES} FROM s GROUP BY 1)) WHERE place <= {most}"
    found["report_lines"] = f"{chosen()} {of('Harnesses', 'harness', 99)} UNION ALL {of('Top models', 'model', 5)}"
    found["custom_interval"] = f"WITH {priced()} SELECT {TOTALS} FROM p WHERE ms >= epoch_ms(TIMESTAMP '2024-01-10') AND ms < epoch_ms(TIMESTAMP '2024-01-20')"
    short = lambda c: f"strftime({c}, '%b %-d')"
    week = core["weekly_90d"]
    found["weekly_buckets"] = f"SELECT *, {short('first')} AS short, {short('first')} || coalesce(' – ' || {short('last')}, '') AS label, coalesce(last, first) = DATE '2024-01-25' AS partial FROM ({week})"
    found["hour_buckets"] = f"SELECT hour, first_ms, tokens, first_ms <= {NOW_MS} AND {NOW_MS} < first_ms + 3600000 AS partial FROM ({_hourly('UTC')})"
    found["bucket_neighbours"] = f"SELECT * FROM (SELECT CAST(first AS VARCHAR) AS key, CAST(lag(first) OVER (ORDER BY first) AS VARCHAR) AS before, CAST(lead(first) OVER (ORDER BY first) AS VARCHAR) AS after FROM ({week})) WHERE key = '2024-01-15'"
    found["session_rows"] = f"{SESSIONS} SELECT session_id, device, harness, coalesce(repository, project) AS project, {ROUND_COST} AS cost_usd, nullif(unpriced_tokens, 0) AS unpriced_tokens, contains(model, ', ') AS multi_model FROM sessions_"
    found["label_overrides"] = f"SELECT key, label FROM ({core['project_labels']}) WHERE label <> short"
    found |= {n: _search(*x) for n, x in {"project_search": ("r1 org", "tokens"), "project_search_fuzzy": ("nme", "name"), "project_search_all": ("", "last_active_ms")}.items()}
    found["model_labels"] = """SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'Claude Opus 4.' || p_partkey % 9 WHEN 1 THEN 'Claude Sonnet ' || p_partkey % 9 || ' (high)' WHEN 2 THEN 'Grok ' || p_partkey % 9 WHEN 3 THEN 'Unreported model' WHEN 4 THEN 'claude-other-1' ELSE 'gpt-' || p_partkey % 9 END AS label FROM part"""
    found["session_links"] = """SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'https://t.example/app/env' || c_custkey % 5 || '/th:' || c_custkey WHEN 2 THEN 'https://t.example/e/other' || c_custkey WHEN 3 THEN 'https://t.example/e/th:' || c_custkey || '?q=1' END AS web,
  CASE c_custkey % 6 WHEN 0 THEN 't3code://threads/env' || c_custkey % 5 || '/th:' || c_custkey END AS native, CASE c_custkey % 4 WHEN 0 THEN 'https://github.com/o/r' || c_custkey END AS repository,
  CASE WHEN c_custkey % 2 = 0 AND c_custkey % 10 <> 0 THEN 'https://cursor.com/agents/s' || c_custkey END AS agent,
  CASE WHEN c_custkey % 3 = 0 THEN 'N' ELSE CASE c_custkey % 4 WHEN 0 THEN 'o/r' || c_custkey WHEN 1 THEN CAST(c_custkey AS VARCHAR) WHEN 2 THEN 'host.example' ELSE 'b/c' END END AS name FROM customer"""
    found["axis_peaks"] = """WITH v AS (SELECT o_orderkey AS k, CAST(CAST(floor(o_totalprice) AS BIGINT) % 100000 AS DOUBLE) AS v FROM orders), u AS (SELECT *, CASE WHEN v > 0 THEN pow(10, floor(log10(v / 4))) END AS p FROM v)
SELECT k, round(CASE WHEN v <= 0 THEN 1 ELSE 4 * p * list_min(list_filter([1, 1.25, 1.5, 2, 2.5, 3, 4, 5, 7.5, 10.0], lambda x: x >= v / (4 * p) OR x = 10)) END, 6) AS peak FROM u"""
    found["collector_versions"] = "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 AND regexp_full_match(n_name, '[0-9A-Za-z.-]+') THEN '0.4.1+' || n_name ELSE '0.4.1' END AS version FROM nation"
    found["catalog_merge"] = """WITH p AS (SELECT p_brand || '/' || p_size AS model, ['input_cost_per_token', 'output_cost_per_token', 'cache_read_input_token_cost'][p_partkey % 3 + 1] AS field, p_retailprice AS rate, p_size % 4 = 0 AND p_partkey % 2 = 0 AS second, p_size % 8 = 0 AND p_partkey % 5 = 0 AS third FROM part),
m AS (SELECT *, bool_or(second) OVER (PARTITION BY model) AS has_second, bool_or(third) OVER (PARTITION BY model) AS has_third FROM p)
SELECT model, field, max(rate) AS rate FROM m WHERE CASE WHEN has_third THEN third WHEN has_second THEN second ELSE true END GROUP BY 1, 2"""
    found["changed_since"] = f"SELECT name, CASE WHEN rank = 2 THEN tokens + 1 ELSE tokens END AS tokens, rank FROM ({_by('model')}) WHERE rank IN (2, 3)"
    found["migration_pages"] = f"""WITH {EV}, r AS (SELECT CASE WHEN event_id % 3 = 0 THEN '2023-12' ELSE '' END AS pricing_snapshot, ms // 86400000 AS day, row_number() OVER (PARTITION BY event_id % 3 = 0, ms // 86400000 ORDER BY ms, device_id, id) - 1 AS i FROM ev)
SELECT pricing_snapshot, day, i // 25 AS batch, count(*) AS n FROM r GROUP BY 1, 2, 3"""
    return found
