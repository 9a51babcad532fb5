"""Calendars, prices, logs, replays, merges and the stream on small hand-made inputs."""

import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from metergrid.operators import dedupe, merge, pricing
from metergrid.plans.query import UsageQuery, filter_text, filter_values, timeframe
from metergrid.schema import USAGE_EVENT
from metergrid.sources import billing, logs


def _frame(range_, zone, now):
    return timeframe(UsageQuery(range=range_, timezone=zone), datetime.fromisoformat(now))


def test_changed_clocks_and_short_months():
    assert len(_frame("today", "America/Los_Angeles", "2026-03-08T23:30:00-07:00").hours) == 23
    assert len(_frame("today", "America/Los_Angeles", "2026-11-01T23:30:00-08:00").hours) == 25
    assert len(_frame("7d", "UTC", "2024-01-25T15:30:00+00:00").days) == 8
    six = _frame("6m", "UTC", "2025-08-30T12:00:00+00:00")
    assert str(six.days[0][0]) == "2025-02-28" and len(six.days) == 184


def test_query_parameters():
    query, warnings = UsageQuery(timezone="Mars/Base", models=("b", "a", "b")).normalized()
    assert query.timezone == "UTC" and query.models == ("a", "b") and warnings
    for values in (None, (), ("a", "b"), ("a,b",), ("none",)):
        assert filter_values(filter_text(values)) == values


def test_rules(spark):
    with pytest.raises(ValueError):
        pricing.check_rules([{"model": "a", "kind": "alias", "target": "b"}, {"model": "b", "kind": "alias", "target": "a"}])
    catalog = spark.createDataFrame([("xai/m", pricing.INPUT, 1e-6), ("xai/m", pricing.OUTPUT, 2e-6)], "model string, field string, rate double")
    rules = [{"model": "a", "kind": "alias", "target": "b"}, {"model": "b", "kind": "alias", "target": "m"}, {"model": "f", "kind": "free"}]
    found = {r["raw_model"]: (r["model"], r["kind"]) for r in pricing.resolve_models(spark.createDataFrame([(x,) for x in ("a", "m", "f", "zz")], "raw_model string"), catalog, rules).collect()}
    assert found == {"a": ("xai/m", "alias"), "m": ("xai/m", "catalog"), "f": ("f", "free"), "zz": ("zz", "none")}


SECRET = "never-in-any-output"


def _lines(spark, records, file="f"):
    return spark.createDataFrame([(file, i + 1, json.dumps(r)) for i, r in enumerate(records)], "file string, line long, value string")


def test_claude_log(spark):
    usage = {"input_tokens": 2, "cache_read_input_tokens": 100, "cache_creation_input_tokens": 10, "cache_creation": {"ephemeral_1h_input_tokens": 12, "ephemeral_5m_input_tokens": 8}, "output_tokens": 9, "service_tier": " standard ",
             "output_tokens_details": {"thinking_tokens": 30}, "iterations": [{"type": "message", "input_tokens": 9}, {"type": "advisor_message", "model": "x", "input_tokens": 5, "output_tokens": 1, "speed": "fast"}, {"type": "advisor_message", "input_tokens": 5}, {"type": "advisor_message", "model": "y", "output_tokens": "7", "input_tokens": 3}]}
    base = {"type": "assistant", "timestamp": "2026-01-01T00:00:00Z", "sessionId": "s", "cwd": "/w", "requestId": "r1"}
    records = [
        base | {"message": {"id": "m1", "model": "c", "usage": usage, "content": SECRET}}, base | {"message": {"id": "m2", "model": "<synthetic>", "usage": usage}}, {"type": "user", "message": {"content": SECRET}},
        {"type": "assistant", "timestamp": 1767225600, "uuid": "u1", "message": {"usage": {"input_tokens": 4}}}, {"type": "assistant", "timestamp": 1767225600, "message": {"usage": {"input_tokens": 4}}},
        base | {"message": {"id": "m3", "model": "c", "usage": {}}}, base | {"timestamp": "never", "message": {"id": "m4", "usage": usage}},
    ]
    lines = _lines(spark, records, "/logs/file-1.jsonl")
    rows = {r["id"]: r for r in logs.claude(lines).collect()}
    advisor = lambda n: "claude:advisor:" + hashlib.sha256(json.dumps(["claude:message:m1:r1", n], separators=(",", ":")).encode()).hexdigest()
    fallback = "claude:metadata:" + hashlib.sha256(b'["file-1","2026-01-01T00:00:00.000Z",5]').hexdigest()
    assert set(rows) == {"claude:message:m1:r1", advisor(0), advisor(2), "claude:uuid:u1", fallback}
    main = rows["claude:message:m1:r1"]
    assert [main[c] for c in ("input_tokens", "cache_read_tokens", "cache_write_tokens", "cache_write_1h_tokens", "output_tokens", "reasoning_tokens", "service_tier", "session_id", "project")] == [2, 100, 20, 12, 9, 9, "standard", "s", "/w"]
    x, y = rows[advisor(0)], rows[advisor(2)]
    assert (x["raw_model"], x["service_tier"], x["parent_id"], x["legacy_id"]) == ("x", "priority", "claude:message:m1:r1", advisor(1))
    assert (y["input_tokens"], y["output_tokens"], y["legacy_id"], y["service_tier"]) == (3, 0, advisor(3), "standard")
    assert (rows["claude:uuid:u1"]["session_id"], rows["claude:uuid:u1"]["raw_model"], rows["claude:uuid:u1"]["project"]) == ("file-1", "unknown", "Unknown project")
    assert [tuple(r) for r in logs.claude_empty(lines).collect()] == [("m3", "s", "claude:message:m3:r1")]
    assert SECRET not in str(rows)


def _assistant(i: int, **usage) -> str:
    return json.dumps({"type": "assistant", "timestamp": "2026-01-05T10:00:00Z", "sessionId": "s", "requestId": "r", "message": {"id": f"m{i}", "model": "x", "usage": usage}})


def test_an_empty_request_in_two_files_is_one_row(spark):
    lines = spark.createDataFrame([("/l/a.jsonl", 1, _assistant(1)), ("/l/b.jsonl", 1, _assistant(1)), ("/l/b.jsonl", 2, _assistant(2, input_tokens=5))], "file string, line long, value string")
    assert [tuple(r) for r in logs.claude_empty(lines).collect()] == [("m1", "s", "claude:message:m1:r")]


def _parses(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("from_json(")


def test_readers_parse_a_record_once(spark):
    lines = spark.createDataFrame([("/l/a.jsonl", 1, _assistant(1, input_tokens=5))], "file string, line long, value string")
    assert _parses(logs.claude(lines)) == 1
    assert _parses(logs.claude_empty(lines)) == 1
    # once for the rows of segments, once for what the segments start with
    assert _parses(logs.muse(lines)) == 2


def test_withdrawn_ids_need_no_removal_of_copies(spark):
    from metergrid.operators import collect

    lines = spark.createDataFrame([("/l/a.jsonl", 1, _assistant(1, input_tokens=5))], "file string, line long, value string")
    assert "row_number()" not in collect.claude_collection(lines).withdrawn._jdf.queryExecution().optimizedPlan().toString()


def test_replays_of_one_billed_original_go(spark):
    row = lambda i, native, side, n, parent=None: (i, native, "s", side, parent, n, 0, 0, 0)
    schema = "id string, native_id string, session_id string, sidechain boolean, parent_id string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long"
    rows = spark.createDataFrame([row("a", "m", False, 5), row("a2", "m", True, 9), row("b", "n", False, 5), row("b2", "n", True, 9), row("c2", "o", True, 1), row("a", "m", True, 2), row("x", None, True, 1)], schema)
    empty = spark.createDataFrame([("n", "s", "other")], "native_id string, session_id string, id string")
    assert sorted(r["id"] for r in dedupe.without_replays(rows, empty).collect()) == ["a", "b", "b2", "c2", "x"]
    assert [r["id"] for r in dedupe.replayed(rows, empty).collect()] == ["a2"]


def _count(at, n, cached, out, last=None, written=0, total=None, **more):
    usage = {"input_tokens": n, "cached_input_tokens": cached, "output_tokens": out, "reasoning_output_tokens": 1, "cache_creation_input_tokens": written} | ({} if total is None else {"total_tokens": total})
    info = {"total_token_usage": usage} | ({"last_token_usage": last} if last else {})
    return {"type": "event_msg", "timestamp": f"2026-01-01T00:00:{at:02}Z", "payload": {"type": "token_count", "info": info}} | more


def _meta(session, at=0, **more):
    return {"type": "session_meta", "timestamp": f"2026-01-01T00:00:{at:02}Z", "payload": {"id": session, "cwd": "/w"} | more}


def test_codex_counters(spark):
    turn = {"type": "turn_context", "payload": {"model": "g", "text": SECRET, "service_tier": "flex"}, "timestamp": "2026-01-01T00:00:00Z"}
    applied = {"type": "event_msg", "payload": {"type": "thread_settings_applied", "thread_settings": {"service_tier": "fast"}}}
    records = [
        _meta("s"), turn, _count(1, 100, 60, 20), _count(2, 100, 60, 20), _count(3, 300, 200, 50, written=70), applied, _count(4, 40, 30, 10), _count(5, 90, 30, 10, last={"input_tokens": 7, "output_tokens": 1}), _meta("parent"),
        _count(6, 100, 30, 10, total=0), _count(7, 110, 30, 10, total=5),
    ]
    found, withdrawn = logs.codex(_lines(spark, records))
    rows = found.orderBy("line").collect()
    assert [(r["input_tokens"], r["cache_read_tokens"], r["cache_write_tokens"], r["output_tokens"]) for r in rows] == [(40, 60, 0, 20), (0, 140, 60, 30), (10, 30, 0, 10), (7, 0, 0, 1), (10, 0, 0, 0), (10, 0, 0, 0)]
    assert {(r["raw_model"], r["project"], r["session_id"]) for r in rows} == {("g", "/w", "s")} and [r["service_tier"] for r in rows] == ["flex", "flex", "fast", "fast", "fast", "fast"]
    first = hashlib.sha256(b'["s","2026-01-01T00:00:01.000Z",40,20,60,0,1]').hexdigest()
    assert rows[0]["id"] == f"codex:total:{first}" and not withdrawn.collect() and SECRET not in str(rows)


def _single(at, response, n, thread="s", turn=None, **more):
    return {"type": "token_usage_record", "timestamp": f"2026-01-01T00:00:{at:02}Z", "payload": {"response_id": response, "usage": {"input_tokens": n, "output_tokens": 1}} | ({"thread_id": thread} if thread else {}) | ({"turn_id": turn} if turn else {}) | more}


def test_codex_single_records_and_compactions(spark):
    turn = lambda t, model: {"type": "turn_context", "payload": {"turn_id": t, "model": model, "cwd": f"/{t}"}}
    records = [
        _meta("s"), turn("t1", "g1"), _count(1, 10, 0, 1), _single(2, "c1", 5, thread=None), _count(3, 15, 0, 2, last={"input_tokens": 5, "output_tokens": 1}), {"type": "compacted", "payload": {"compaction_response_id": "c1"}},
        _single(4, "c2", 6, thread=None), {"type": "compacted", "payload": {"compaction_response_id": "c2"}}, _single(5, "lost", 7, thread=None), turn("t2", "g2"), _single(6, "r1", 8, turn="t1"), _single(7, "other", 9, thread="x"), _count(8, 99, 0, 9), _single(9, "r2", 3),
    ]
    found, withdrawn = logs.codex(_lines(spark, records))
    got = {r["id"].split(":")[1] + ":" + r["id"].split(":")[2][:2]: (r["input_tokens"], r["raw_model"], r["project"]) for r in found.collect()}
    assert {k: v for k, v in got.items() if k.startswith("response")} == {"response:c1": (5, "g1", "/t1"), "response:c2": (6, "g1", "/t1"), "response:r1": (8, "g1", "/t1"), "response:r2": (3, "g2", "/t2")}
    assert [v[0] for k, v in got.items() if k.startswith("total")] == [10] and not withdrawn.collect()


def test_codex_forks_withdraw_what_they_copied(spark):
    task = lambda at: {"type": "event_msg", "timestamp": "2026-01-01T00:01:00Z", "payload": {"type": "task_started", "started_at": at}}
    child = [_meta("c", 30, forked_from_id="p"), _meta("p"), task("2026-01-01T00:00:05Z"), _count(40, 50, 0, 1), task("2026-01-01T00:00:45Z"), _count(46, 80, 0, 2)]
    lines = _lines(spark, child, "c").union(_lines(spark, [_meta("p"), _count(6, 50, 0, 1)], "p"))
    found, withdrawn = logs.codex(lines)
    assert sorted((r["session_id"], r["input_tokens"]) for r in found.collect()) == [("c", 30), ("p", 50)] and len(withdrawn.collect()) == 1
    files = {r["session_id"]: r for r in logs.codex_files(lines).collect()}
    assert (files["c"]["parent_id"], files["c"]["boundary"]) == ("p", 5) and files["p"]["boundary"] is None


def test_codex_copies_of_a_parent_go(spark):
    schema = "session_id string, id string, ms long, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, reasoning_tokens long"
    row = lambda s, i, ms, n: (s, i, ms, n, 0, 0, 0, 0)
    rows = spark.createDataFrame([row("p", "codex:total:1", 10, 5), row("c", "codex:total:2", 10, 5), row("c", "codex:response:3", 10, 5), row("c", "codex:total:4", 11, 5), row("c", "codex:total:5", 3, 6), row("g", "codex:total:6", 10, 5), row("g", "codex:total:7", 11, 5)], schema)
    files = spark.createDataFrame([("p", None, None), ("c", "p", 5), ("g", "c", 5)], "session_id string, parent_id string, forked_ms long")
    assert sorted(r["id"][-1] for r in dedupe.without_parent_records(rows, files).collect()) == ["1", "3", "4", "6"]


def test_pi_branches_belong_to_their_origin(spark):
    msg = lambda i, at, n: {"type": "message", "id": i, "timestamp": 1767225600000 + at * 1000, "message": {"role": "assistant", "usage": {"input": n, "output": 3, "cacheRead": 5, "cacheWrite": 2, "cacheWrite1h": 9, "reasoning": 7}}}
    head = lambda i, at, **more: {"type": "session", "id": i, "cwd": "/w", "timestamp": 1767225600000 + at * 1000} | more
    lines = _lines(spark, [head("a", 0), {"type": "model_change", "modelId": "p1"}, msg("m", 1, 7), msg("x", 90, 1)], "a").union(_lines(spark, [head("b", 50, parentSession="/d/2026_a.jsonl"), msg("m", 1, 9), msg("x", 90, 1), msg("n", 60, 4), msg("y", 30, 2)], "b"))
    rows = logs.pi(lines)
    one = {r["id"]: r for r in rows.collect()}["pi:a:m"]
    assert [one[c] for c in ("raw_model", "input_tokens", "cache_read_tokens", "cache_write_1h_tokens", "reasoning_tokens", "project")] == ["p1", 7, 5, 2, 3, "/w"]
    found = dedupe.original_owners(rows, logs.pi_files(lines)).collect()
    assert sorted((r["id"], r["withdrawn"], r["sidechain"], r["session_id"]) for r in found if r["withdrawn"]) == [("pi:a:m", "pi:b:m", True, "a"), ("pi:a:x", "pi:b:x", True, "a"), ("pi:a:y", "pi:b:y", True, "a")]
    assert sorted(r["id"] for r in found if not r["withdrawn"]) == ["pi:a:m", "pi:a:x", "pi:b:n"]


def test_grok_ledgers_and_updates(spark):
    use = {"inputTokens": 100, "cachedReadTokens": 30, "cacheCreationTokens": 80, "outputTokens": 5, "reasoningTokens": 9, "modelCalls": 3, "costUsdTicks": 20000000}
    turns = [
        {"turnNumber": 1, "endedAt": "2026-01-01T00:00:00Z", "modelUsage": {"g": use, "h/1": use | {"costIsPartial": True}, "bad": use | {"inputTokens": -1}}}, {"turnNumber": 2, "endedAt": 1767225600, "primaryModelId": "k"} | use,
        {"turnNumber": 0, "endedAt": 1767225600} | use, {"turnNumber": 3, "endedAt": 1767225600, "usageIsIncomplete": True} | use,
    ]
    ledger = spark.createDataFrame([("f", "a b", "/w", "dm", json.dumps({"sessionId": "a b", "turns": turns})), ("g", "z", "/w", "", json.dumps({"sessionId": "other", "turns": turns}))], "file string, session_id string, project string, model string, value string")
    rows = {r["id"]: (r["input_tokens"], r["cache_read_tokens"], r["cache_write_tokens"], r["reasoning_tokens"], r["reported_cost_usd"], r["requests"]) for r in logs.grok(ledger).collect()}
    assert rows == {"grok:turn:a%20b:1:g": (0, 30, 70, 5, 0.002, 3), "grok:turn:a%20b:1:h%2F1": (0, 30, 70, 5, None, 3), "grok:turn:a%20b:2:k": (0, 30, 70, 5, 0.002, 3), "grok:turn:a%20b:3:dm": (0, 30, 70, 5, None, 3)}
    done = lambda e, n, model=None: json.dumps({"timestamp": 1767225600, "params": {"_meta": {"eventId": e}, "update": {"sessionUpdate": "turn_completed", "usage": use | {"inputTokens": n}} | ({"_meta": {"modelId": model}} if model else {})}})
    schema = "file string, session_id string, project string, model string, line long, value string"
    updates = spark.createDataFrame([("u", "s", "/w", "dm", i + 1, v) for i, v in enumerate([done("e1", 100), done(None, 200, "m2"), done("e1", 300), done("e3", 400)])] + [("v", "a b", "/w", "dm", 1, done("q", 1))], schema)
    both = sorted((r["id"], r["input_tokens"]) for r in logs.grok_sessions(ledger, updates).collect() if r["session_id"] == "s")
    assert both == [("grok:turn:s:1:m2", 190), ("grok:turn:s:2:m2", 90), ("grok:turn:s:3:m2", 290)]
    assert not [r for r in logs.grok_sessions(ledger, updates).collect() if r["id"].startswith("grok:turn:a%20b:1:dm")]


def test_muse_paths(spark):
    paths = ["/d/2026/s1/session.jsonl", "/d/2026/s1/subagent/c1/session.jsonl", "/d/s1/workflows/w.jsonl", "x.jsonl"]
    rows = spark.createDataFrame([(p,) for p in paths], "file string").select(*logs.muse_path_ids())
    assert [tuple(r) for r in rows.collect()] == [("s1", None), ("c1", "s1"), ("w", "s1"), ("x", None)]


def test_projects_of_enclosing_sessions(spark):
    rows = spark.createDataFrame([("a", "1", 1, "/w"), ("b", "2", 2, "Unknown project"), ("c", "3", 3, "Unknown project"), ("d", "4", 4, "/x")], "session_id string, id string, ms long, project string")
    files = spark.createDataFrame([("a", None), ("b", "m"), ("m", "a"), ("c", None)], "session_id string, parent_id string")
    assert {r["id"]: r["project"] for r in dedupe.parent_projects(rows, files, "Unknown project").collect()} == {"1": "/w", "2": "/w", "3": "Unknown project", "4": "/x"}


def test_incomplete_last_lines_and_malformed_ones(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.jsonl").write_text('{"a":1}\nnot json\n{"b":2}\n{"incompl')
    lines = logs.read_lines(spark, str(tmp_path))
    assert sorted((r["line"], r["value"]) for r in lines.collect()) == [(1, '{"a":1}'), (2, "not json"), (3, '{"b":2}')]
    assert [(r["lines"], r["malformed"]) for r in logs.malformed(lines).collect()] == [(3, 1)]


def test_billing_export(spark, tmp_path):
    path = tmp_path / "b.csv"
    head = "Product,Charge Category,Billing Item ID,Event Time,Model,Usage\n"
    good = 'cursor,usage,i1,2026-01-01T00:00:00Z,m,"{""prompt-text-tokens"":""5"",""cached-prompt-text-tokens"":7}"\n'
    path.write_text(head + good + good + "Other,usage,,x,m,{}\n")
    got = billing.read_billing(spark, str(path)).collect()
    assert [(r["id"], r["input_tokens"], r["cache_read_tokens"], r["output_tokens"], r["requests"], r["session_id"]) for r in got] == [("cursor:billing-item:i1", 5, 7, 0, 0, "")]
    for bad in ("cursor,usage,,2026-01-01T00:00:00Z,m,{}", "cursor,usage,i,2026-01-01,m,{}", 'cursor,usage,i,2026-01-01T00:00:00Z,m,"{""input"":5}"', "cursor,usage,i,2026-01-01T00:00:00Z,m,{}", "cursor,usage,i,2026-01-01T00:00:00Z,m,[1]",
                'cursor,usage,i,2026-01-01T00:00:00Z,m,"{""prompt-text-tokens"":-5}"', good.replace("5", "6").strip(), "cursor,usage,i,2026-01-01T00:00:00Z,m,no"):
        path.write_text(head + good + bad + "\n")
        with pytest.raises(ValueError):
            billing.read_billing(spark, str(path))
    path.write_text(head)
    with pytest.raises(ValueError):
        billing.read_billing(spark, str(path))


def test_near_in_time(spark):
    a = spark.createDataFrame([("x", 10), ("x", 20)], "k string, ms long")
    assert [r["ms"] for r in dedupe.near_in_time(a, spark.createDataFrame([("x", 12), ("y", 20)], "k string, ms long"), ["k"]).collect()] == [10]


def _event(i, ms, tokens=10, device="d", **more):
    base = {f.name: None for f in USAGE_EVENT.fields} | {"id": i, "ms": ms, "ts": datetime.utcfromtimestamp(ms / 1000), "harness": "pi", "session_id": "s", "cost_usd": 0.0, "cost_known": False, "device_id": device}
    base |= {c: 0 for c in ("output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens")} | {"input_tokens": tokens}
    return base | more


def test_stream_merges_corrections_moves_and_retractions(spark, tmp_path):
    from metergrid.streaming.sync import changes, sync

    day = 86_400_000
    rows = lambda *e: spark.createDataFrame(list(e), USAGE_EVENT)
    store, incoming = str(tmp_path / "store"), str(tmp_path / "in")
    rows(_event("a", 1000), _event("b", 2000, session_title="T"), _event("c", day + 5)).withColumn("utc_day", merge.utc_day()).write.partitionBy("utc_day").parquet(store)
    stored = spark.read.parquet(store).schema
    upload = changes(rows(_event("a", 2 * day, 30), _event("b", 2000, 11), _event("n", 3000)), spark.createDataFrame([("d", "c")], "device_id string, id string"))
    upload.write.parquet(incoming)
    for checkpoint in ("one", "two"):  # the second run replays the batch
        sync(spark, incoming, store, str(tmp_path / checkpoint), upload.schema, stored).awaitTermination()
        got = sorted((r["id"], r["ms"], r["input_tokens"], r["session_title"]) for r in spark.read.schema(stored).parquet(store).collect())
        assert got == [("a", 2 * day, 30, None), ("b", 2000, 11, "T"), ("n", 3000, 10, None)]
    for wrong in (_event("", 1), _event("a", 1, reported_cost_usd=float("inf")), _event("a", 1, cost_usd=float("nan")), _event("a", 1, -1)):
        with pytest.raises(ValueError):
            merge.checked(rows(wrong))
    with pytest.raises(ValueError):
        merge.checked(rows(_event("a", 1), _event("b", 1)), rows(_event("c", 1)), most=2)


def test_what_a_merge_keeps(spark):
    rows = lambda *e: spark.createDataFrame(list(e), USAGE_EVENT)
    old = {"session_title": "T", "service_tier": "flex", "requests": 4, "cache_write_1h_tokens": 3, "thread_id": "t", "thread_url": "u", "repository": "github.com/o/r", "project": "/w"}
    stored = rows(*[_event(i, 1000, **old) for i in "abcd"])
    batch = rows(_event("a", 2000, project="/w", repository="local:x"), _event("b", 1000, project="/v", thread_url="u2"), _event("c", 1000, project="/w", thread_id="t"), _event("d", 1000, **old))
    got = {r["id"]: r for r in merge.merged(stored, batch).collect()}
    part = lambda i, *names: tuple(got[i][n] for n in names)
    assert part("a", "session_title", "service_tier", "requests", "cache_write_1h_tokens", "thread_id", "thread_url", "repository", "action") == ("T", None, None, None, "t", "u", "github.com/o/r", "update")
    assert part("b", "thread_id", "thread_url", "repository") == (None, "u2", None) and part("c", "thread_id", "thread_url", "repository") == ("t", "u", None) and got["d"]["action"] == "skip"
    priced = stored.withColumn("pricing_snapshot", F.lit("p1"))
    assert {r["action"] for r in merge.merged(priced, rows(_event("d", 1000, **old)), "p1").collect()} == {"skip"} and {r["action"] for r in merge.merged(priced, rows(_event("d", 1000, **old)), "p2").collect()} == {"update"}


def test_batches_never_pass_a_bound(spark):
    from metergrid.operators.view import batches

    sizes = [1] * 7 + [90, 5, 200, 1, 1]
    rows = spark.createDataFrame([("k", i, n) for i, n in enumerate(sizes)] + [("l", 0, 1)], "k string, i int, n int")
    got = {(r["k"], r["i"]): r["batch"] for r in batches(rows, ["k"], ["i"], "n", most_rows=5, most_bytes=100).collect()}
    assert [got["k", i] for i in range(len(sizes))] == [0, 0, 0, 0, 0, 1, 1, 1, 2, 3, 4, 4] and got["l", 0] == 0


def test_policies(spark):
    catalog = spark.createDataFrame([("m", pricing.INPUT, 1e-6), ("m", pricing.OUTPUT, 2e-6)], "model string, field string, rate double")
    rules = pricing.with_rule(catalog, [{"model": "f", "kind": "free"}], {"model": "a", "kind": "alias", "target": "m"})
    assert [r["model"] for r in rules] == ["a", "f"] and pricing.without_rule(catalog, rules, "a") == [{"model": "f", "kind": "free"}]
    with pytest.raises(ValueError):
        pricing.with_rule(catalog, rules, {"model": "b", "kind": "alias", "target": "nowhere"})
    name = pricing.revision(catalog, rules)
    assert pricing.revision(catalog.orderBy(F.desc("field")), rules) == name != pricing.revision(catalog, [])
    assert pricing.adopted((catalog, []), (catalog, rules), name)[1] == rules
    for claimed, expected in (("x", None), (name, "y")):
        with pytest.raises(ValueError):
            pricing.adopted((catalog, []), (catalog, rules), claimed, expected)
    raw = lambda v: spark.createDataFrame([("m", v), ("n", "3"), ("half", json.dumps({pricing.INPUT: 1}))], "model string, value string")
    good = pricing.decoded_catalog(raw(json.dumps({pricing.INPUT: 1e-6, pricing.OUTPUT: 2e-6, "note": "x", pricing.READ: None})), least=1)
    assert sorted(tuple(r) for r in good.collect()) == [("m", pricing.INPUT, 1e-6), ("m", pricing.OUTPUT, 2e-6)]
    for value, least in (({pricing.INPUT: -1, pricing.OUTPUT: 1}, 1), ({pricing.INPUT: 1, pricing.OUTPUT: 1}, 2)):
        with pytest.raises(ValueError):
            pricing.decoded_catalog(raw(json.dumps(value)), least=least)


def test_muse_records_of_any_depth_with_what_came_before(spark):
    call = lambda i, **more: {"id": i, "recorded_at": 1767225600000000, "payload": {"event": {"kind": "model_completed", "usage": {"input_tokens": 9, "cached_tokens": 4, "cache_read_tokens": 3, "output_tokens": 2}}}} | more
    deep = call("deep")
    for _ in range(9):
        deep = {"children": [{"record_json": json.dumps(deep)}]}
    told = {"stream": {"kind": "session", "id": "s"}, "payload_type": "run.model.configured", "payload": {"record": {"model_id": "m", "workspace_root": "/w"}}}
    judge = call("judge", stream={"kind": "approval-review", "id": "j"})
    rows = logs.muse(_lines(spark, [call("early"), told, judge, deep])).collect()
    got = {r["id"]: (r["raw_model"], r["project"], r["input_tokens"], r["cache_read_tokens"]) for r in rows}
    assert got == {"muse:record:early": ("unknown", "Unknown project", 5, 4), "muse:record:deep": ("m", "/w", 5, 4)}
    assert {r["session_id"] for r in rows if r["id"] == "muse:record:deep"} == {"s"}


def test_ancestors_of_any_depth(spark):
    from metergrid.operators.dedupe import ancestors

    rows = [(f"s{i}", f"s{i - 1}" if i else None) for i in range(41)] + [("x", "y"), ("y", "x")]
    got = ancestors(spark.createDataFrame(rows, "session_id string, parent_id string"), depth=4).collect()
    want = {(f"s{i}", f"s{j}", i - j) for i in range(41) for j in range(i)} | {("x", "y", 1), ("y", "x", 1)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_source_roots(spark):
    from metergrid.sources.roots import grok_project, source_roots

    found = source_roots({"CODEX_HOME": "~/c, /d/sessions ,~/c", "XDG_DATA_HOME": "/x"}, "/h")
    assert found == [("claude", "/h/.claude/projects"), ("codex", "/h/c/sessions"), ("codex", "/h/c/archived_sessions"), ("codex", "/d/sessions"), ("pi", "/h/.pi/agent/sessions"), ("grok", "/h/.grok/sessions"), ("muse", "/x/muse/sessions")]
    rows = spark.createDataFrame([("/s/%2Fhome%2Fu%2Fp/s1/usage.json",), ("/s/short/s2/usage.json",), ("x",)], "file string")
    assert [r[0] for r in rows.select(grok_project()).collect()] == ["/home/u/p", None, None]


def test_refreshed_snapshots(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "id string, session_id string, n int")
    events, gone = billing.refreshed(rows(("a", "1", 1), ("b", "1", 1), ("c", "2", 1)), rows(("a", "1", 2)), rows(("x", "1", 0)))
    assert sorted(tuple(r) for r in events.collect()) == [("a", "1", 2), ("c", "2", 1)] and [r["id"] for r in gone.collect()] == ["b"]


def test_metadata_of_threads_and_repositories(spark):
    from metergrid.operators.collect import with_metadata

    events = spark.createDataFrame([("codex", "s", "/a"), ("codex", "t", "/b"), ("pi", "s", "/c")], "harness string, session_id string, project string")
    threads = spark.createDataFrame([("codex", "s", "T2", None, "id2", None, "/z", 2), ("codex", "s", "T1", "P", "id1", "u", "/y", 1)], "harness string, session_id string, session_title string, project_name string, thread_id string, thread_url string, project string, priority int")
    repos = spark.createDataFrame([("/a", "local:a"), ("/y", "github.com/o/y"), ("/b", "github.com/o/b")], "project string, repository string")
    got = {(r["harness"], r["session_id"]): (r["session_title"], r["thread_id"], r["repository"]) for r in with_metadata(events, threads, repos).collect()}
    assert got == {("codex", "s"): ("T1", "id1", "github.com/o/y"), ("codex", "t"): (None, None, "github.com/o/b"), ("pi", "s"): (None, None, None)}


def test_thread_links_and_deleted_threads(spark):
    from metergrid.sources import threads

    one = spark.range(1).select(
        threads.thread_url("https://host/a//", "e/1", F.lit("t (1)~!")).alias("url"), threads.thread_url("https://u:p@host", "e", F.lit("t")).alias("user"),
        threads.thread_url("ftp://host", "e", F.lit("t")).alias("ftp"), threads.thread_url("https://host", None, F.lit("t")).alias("none"),
    ).first()
    assert tuple(one) == ("https://host/a/e%2F1/t%20(1)~!", None, None, None)
    payload = '{"nativeThreadRef": {"nativeId": "%s", "driver": "pi"}}'
    bound = spark.createDataFrame([(0, "a", payload % "n", 1), (0, "b", payload % "n", 2), (1, "c", payload % "m", 1), (1, "a", payload % "x", 1), (0, "a", " " * 262_144 + payload % "long", 1)], "db long, thread_id string, payload_json string, updated_at long")
    current = spark.createDataFrame([(0, "a", "p", "A", "{}", None), (0, "b", "p", "B", None, None), (1, "c", None, None, "{}", "gone"), (1, "a", "p", "A", "{}", "gone")], "db long, thread_id string, project_id string, title string, payload_json string, deleted_at string")
    projects = spark.createDataFrame([(0, "p", "No project", " /w ")], "db long, project_id string, title string, workspace_root string")
    bindings = threads.current_bindings(bound, current, projects)
    got = {r["session_id"]: (r["thread_id"], r["session_title"], r["project_name"], r["thread_url"], r["repository_paths"]) for r in threads.thread_metadata(bindings, current, "http://h", "e").collect()}
    assert got == {"n": ("b", "B", None, "http://h/e/b", ["/w"]), "m": ("c", None, None, "", []), "x": ("a", None, None, "", [])}
    assert threads.thread_metadata(bindings.limit(0), current.limit(0), "http://h", "e").collect() == []
