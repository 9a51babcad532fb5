"""Wire decoder, reconciliation, Grok trees and snapshots on small hand-made inputs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metergrid import log_queries
from metergrid.sources import grok_tree, reconcile, snapshots, wire
from metergrid.tables import Scratch


def number(n):
    out = bytearray()
    while True:
        out.append(n & 0x7F | (0x80 if n > 0x7F else 0))
        n >>= 7
        if not n:
            return bytes(out)


def put(field, value):
    if isinstance(value, int):
        return number(field << 3) + number(value)
    raw = value.encode() if isinstance(value, str) else value
    return number(field << 3 | 2) + number(len(raw)) + raw


@given(st.integers(0, 2**64 - 1))
def test_varints(n):
    assert wire.varint(number(n), 0, 10) == (n, len(number(n)))


@given(st.binary(max_size=60))
@settings(max_examples=500, deadline=None)
def test_any_bytes_are_a_message_or_malformed(data):
    for read in (wire.generator, wire.step):
        try:
            assert set(read(data)) <= {f.name for f in (*wire.GENERATORS, *wire.STEPS)}
        except wire.Malformed:
            pass


def test_fields_of_messages():
    usage = put(2, 5) + put(11, " r1 ") + put(7, "m") + put(99, "prompt") + number(50 << 3 | 5) + b"four"
    data = put(1, put(4, usage) + put(19, "models/x")) + put(2, number(3) + number(300)) + put(2, 7) + put(3, put(28, "p")) + put(1, put(3, 9))
    found = wire.generator(data)
    assert (found["step_indices"], found["input_tokens"], found["output_tokens"], found["response_id"], found["message_id"], found["model_enum"], found["planner_model"]) == ([3, 300, 7], 5, 0, "r1", "m", 9, "p")
    moment = lambda s, n: put(1, s) + put(2, n)
    step = wire.step(put(8, moment(1767225600, 5_000_000)) + put(1, moment(1, 0)) + put(11, 4) + put(9, put(2, 1)))
    assert step["stamp"] == "2026-01-01T00:00:00.005Z" and step["model_enum"] == 4 and step["input_tokens"] == 1
    assert wire.step(put(1, b""))["stamp"] == "1970-01-01T00:00:00.000Z" and wire.step(put(8, moment(1, 2_000_000_000)))["stamp"] is None
    assert wire.step(put(9, put(2, 2**60)))["malformed"] and "input_tokens" not in wire.step(put(9, put(2, 2**60)))
    for bad in (b"\x08", b"\x0b", put(1, "x")[:-1], number(1 << 3 | 1) + b"short", b"\x00\x01", put(1, put(4, put(11, "x" * 513))), put(2, b"\xff" * 11)):
        with pytest.raises(wire.Malformed):
            wire.generator(bad)


def test_blobs_in_a_table(spark):
    rows = spark.createDataFrame([("c", 1, bytearray(put(1, put(4, put(2, 5))))), ("c", 2, bytearray(b"\x08")), ("c", 3, None), ("c", 4, bytearray())], "conversation string, idx long, data binary")
    found = wire.generators(rows.withColumn("malformed", F.lit("clash")))
    assert sorted((r["idx"], r["malformed"], r["input_tokens"]) for r in found.collect()) == [(1, False, 5), (2, True, None)]
    assert wire.generators(rows.limit(0)).count() == 0


USAGE = "response_id string, message_id string, provider_id string, tier string, model_enum long, execution_id string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, thinking_tokens long, response_tokens long"


def _calls(spark, generators, steps, executors=(), spare=()):
    """{id: (input tokens, model, tier, stamp)} and the withdrawn ids, without the prefix."""
    record = lambda r: (r.get("rid"), r.get("mid"), r.get("pid"), r.get("tier"), r.get("enum"), r.get("run"), r.get("n"), r.get("out", 0), 0, 0, 0, 0)
    g = spark.createDataFrame([("c", r["i"], r.get("refs", []), r.get("model"), None, *record(r)) for r in generators], f"conversation string, idx long, step_indices array<long>, response_model string, planner_model string, {USAGE}")
    s = spark.createDataFrame([("c", r["i"], r.get("at"), *record(r)) for r in steps], f"conversation string, idx long, stamp string, {USAGE}")
    e = spark.createDataFrame([("c", *x) for x in executors], "conversation string, idx long, execution_id string, model string")
    c = spark.createDataFrame([("c", x) for x in spare], "conversation string, fallback_stamp string")
    with Scratch(spark) as tmp:
        calls, gone = reconcile.reconcile(g, s, e, c, tmp)
        cut = lambda x: x.removeprefix("antigravity:c:")
        return {cut(r["id"]): (r["input_tokens"], r["model"], r["tier"], r["stamp"]) for r in calls.collect()}, {cut(r["id"]) for r in gone.collect()}


def test_a_call_recorded_by_both(spark):
    calls, gone = _calls(spark, [{"i": 0, "mid": "m1", "refs": [4], "n": 9, "model": "models/x-high", "enum": 3}], [{"i": 4, "rid": "r1", "mid": "m1", "n": 5, "at": "t4", "tier": " Fast "}])
    assert calls == {"response:r1": (9, "x-high", "fast", "t4")} and gone == {"response:m1", "step:4", "gen:0"}


def test_an_ambiguous_alias_decides_nothing(spark):
    steps = [{"i": 1, "rid": "r1", "mid": "m", "n": 1, "at": "t"}, {"i": 2, "rid": "r2", "mid": "m", "n": 2, "at": "t"}]
    # two calls share a message id: a generator with a response id of its own goes by that
    calls, _ = _calls(spark, [{"i": 0, "rid": "r3", "mid": "m", "n": 7, "refs": []}], steps, spare=["t0"])
    assert {k: v[0] for k, v in calls.items()} == {"response:r3": 7, "response:r1": 1, "response:r2": 2}
    # without one it has two steps to choose from, and neither is its own
    calls, _ = _calls(spark, [{"i": 0, "mid": "m", "n": 7}], steps, spare=["t0"])
    # it covers what shares its alias, under the alias itself
    assert {k: v[0] for k, v in calls.items()} == {"response:m": 7}
    # unless it refers to one of them
    calls, gone = _calls(spark, [{"i": 0, "mid": "m", "n": 7, "refs": [2]}], steps)
    assert {k: v[0] for k, v in calls.items()} == {"response:r2": 7, "response:r1": 1} and {"response:m", "step:2", "gen:0"} <= gone


def test_records_without_aliases_tokens_or_time(spark):
    generators = [{"i": 0, "n": 3, "refs": [7, 5]}, {"i": 1, "n": 0, "refs": [6]}, {"i": 2, "n": 4}, {"i": 3, "refs": [5]}]
    steps = [{"i": 5, "at": "t5"}, {"i": 6, "n": 2, "at": "t6", "run": "x"}, {"i": 7, "n": 8}, {"i": 8, "n": 1}]
    calls, gone = _calls(spark, generators, steps, [(0, "x", "models/z-low"), (1, "x", "w")])
    # the first step it refers to with usage that fits is its own; a generator without tokens covers nothing
    assert calls == {"step:7": (3, "unknown", "", "t5"), "step:6": (2, "w", "", "t6")} and gone == {"gen:0"}
    calls, _ = _calls(spark, generators, steps, spare=["t0"])
    assert {k: v[0] for k, v in calls.items()} == {"step:7": 3, "step:6": 2, "gen:2": 4, "step:8": 1}
    assert _calls(spark, [], []) == ({}, set())


def test_steps_cover_later_ones(spark):
    steps = [{"i": 1, "mid": "a", "pid": "p", "n": 1, "at": "t"}, {"i": 2, "mid": "a", "n": 2, "at": "t"}, {"i": 3, "rid": "r", "mid": "b", "n": 3, "at": "t"}, {"i": 4, "rid": "q", "mid": "b", "n": 4, "at": "t"}, {"i": 5, "pid": "p", "n": 5, "at": "t"}, {"i": 6, "mid": "b", "n": 6, "at": "t"}]
    calls, _ = _calls(spark, [], steps)
    assert {k: v[0] for k, v in calls.items()} == {"response:a": 1, "response:r": 3, "response:q": 4}


def test_forks_of_any_length(spark):
    chain = [(f"s{k}", f"s{k - 1}" if k else None, 100 * k) for k in range(12)] + [("x", "gone", 50), ("l1", "l2", 10**6), ("l2", "l1", 10**6)]
    sessions = spark.createDataFrame(chain, "session_id string, parent_id string, forked_ms long")
    given = [(f"s{k}", 1, "m", 5 + k % 3) for k in range(12)] + [("s11", 2, "m", 1150), ("s11", 3, "m", 1050), ("x", 1, "m", 50), ("x", 2, "m", 51), ("l1", 1, "m", 7)]
    rows = spark.createDataFrame(given, "session_id string, turn long, raw_model string, ms long").selectExpr("*", "session_id AS copy", "concat('grok:turn:', session_id, ':', turn, ':', raw_model) AS id", "false AS sidechain")
    with Scratch(spark) as tmp:
        got = {(r["copy"], r["turn"]): (r["session_id"], r["id"], r["sidechain"]) for r in grok_tree.fork_owners(rows, sessions, tmp).collect()}
        assert all(got[f"s{k}", 1] == ("s0", "grok:turn:s0:1:m", k > 0) for k in range(12))
        assert got["s11", 2] == ("s11", "grok:turn:s11:2:m", False)  # newer than the copy, and nobody else has it
        assert got["s11", 3][0] == "s10"  # older than the copy s11, not than s10
        assert got["x", 1][0] == "gone" and got["x", 2][0] == "x"  # made as the copy was, and the parent is gone
        assert got["l1", 1][0] in ("l1", "l2")  # a circle ends
        none = rows.limit(0)
        assert grok_tree.fork_owners(none, sessions, tmp).count() == 0


def test_roots_through_levels_and_circles(spark):
    many = [(f"d{k}", f"d{k - 1}", "subagent") for k in range(1, 40)]
    sessions = spark.createDataFrame([("d0", None, None), *many, ("o", "missing", "subagent-x"), ("c1", "c2", "subagent"), ("c2", "c1", "subagent"), ("c3", "c2", "subagent"), ("self", "self", "subagent"), ("k", None, None)], "session_id string, parent_id string, kind string")
    links = spark.createDataFrame([("k", "o", 1), ("k", "d5", 2), ("none", "d0", 1)], "child_id string, parent_id string, seq long")
    with Scratch(spark) as tmp:
        got = {r["session_id"]: r["root"] for r in grok_tree.roots(sessions, links, tmp).collect()}
        assert got == {f"d{k}": "d0" for k in range(1, 40)} | {"o": None, "c1": None, "c2": None, "c3": None, "self": None, "k": "d0"}
        lost = {r["session_id"] for r in grok_tree.orphans(sessions, links, sessions.where("session_id <> 'd0'"), tmp).collect()}
        assert lost == set(got)


def test_projects_of_sessions(spark):
    rows = [("a", "/r/%2Fw%20x/a", None, None), ("b", "/r/plain/b", " /from/cwd\n", None), ("c", "/r/%2Fw/c", None, "/summary"), ("d", "/r/%zz/d", None, " ")]
    found = grok_tree.session_projects(spark.createDataFrame(rows, "session_id string, folder string, cwd_file string, cwd string"))
    assert {r["session_id"]: r["project"] for r in found.collect()} == {"a": "/w x", "b": "/from/cwd", "c": "/summary", "d": "Unknown project"}


def test_snapshots_switch_and_survive(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "id string, session_id string, input_tokens long")
    agents = lambda *x: spark.createDataFrame([(a,) for a in x], "session_id string")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    path, schema = f"{tmp_path}/snap", spark.createDataFrame([], "id string, session_id string, input_tokens long").schema
    first = snapshots.refreshed(snapshots.read(spark, path, schema), frame([("c1", "a", 1), ("c2", "b", 2)]), agents("a", "b"))
    snapshots.write(spark, path, first)
    snapshots.write(spark, path, snapshots.imported(snapshots.read(spark, path, schema), frame([("b1", "", 5)])))
    now = snapshots.read(spark, path, schema)
    assert (now.source, ids(now.events), ids(now.parked), ids(now.withdrawn)) == ("billing", ["b1"], ["c1", "c2"], ["c1", "c2"])
    # an incomplete version is passed over
    (tmp_path / "snap" / "version-00000009").mkdir()
    snapshots.write(spark, path, snapshots.refreshed(snapshots.read(spark, path, schema), frame([("c3", "a", 3)]), agents("a")))
    now = snapshots.read(spark, path, schema)
    assert (now.source, ids(now.events), ids(now.parked), ids(now.withdrawn)) == ("cloud", ["c2", "c3"], ["b1"], ["b1", "c1"])
    with pytest.raises(ValueError):
        snapshots.read(spark, path, spark.createDataFrame([], "id string, session_id string, input_tokens string").schema)
    # a source without any event is remembered
    snapshots.write(spark, path + "2", snapshots.imported(snapshots.empty(spark, schema), spark.createDataFrame([], schema)))
    assert snapshots.read(spark, path + "2", schema).source == "billing"


def test_each_record_is_read_once(spark, sf_dir):
    read = []

    def counted(df):
        n = spark.sparkContext.accumulator(0)
        read.append((n, df.count()))

        def run(batches):
            for batch in batches:
                n.add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, df.schema)

    with Scratch(spark) as tmp:
        calls, gone = reconcile.reconcile(*map(counted, log_queries._recorded_calls(spark, sf_dir)), tmp)
        assert calls.count() and gone.count()
        assert [n.value for n, _ in read] == [rows for _, rows in read]
