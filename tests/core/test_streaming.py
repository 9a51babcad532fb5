"""Live counters and the outbox, with restarts and failures between their steps."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from metergrid import log_queries
from metergrid.operators import store
from metergrid.sources import logs
from metergrid.streaming import counters, outbox
from metergrid.workload import usage_events

COLUMNS = ["file", "line", "id", "ms", "raw_model", "project", "session_id", "service_tier", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens"]


def _run(spark, tmp_path, schema):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = counters.counted(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
    found.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def test_a_streamed_log_gives_what_the_reader_gives(spark, sf_dir, tmp_path):
    lines = log_queries.codex_lines(spark, sf_dir)
    want = sorted(map(repr, logs.codex(lines)[0].select(COLUMNS).collect()))
    # the second half first, then the rest with lines that came before
    late = F.col("line") > 20
    lines.where(late).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert _run(spark, tmp_path, lines.schema).count() == 0, "lines wait for those before them"
    lines.where(~late | (F.col("line") % 3 == 0)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = _run(spark, tmp_path, lines.schema)
    assert want and sorted(map(repr, got.where("NOT needs_batch").select(COLUMNS).collect())) == want
    assert _run(spark, tmp_path, lines.schema).count() == got.count(), "a restart adds nothing"


def test_resets_context_and_logs_left_to_the_batch_reader(spark, tmp_path):
    usage = lambda i, o: {"input_tokens": i, "output_tokens": o, "total_tokens": i + o}
    count = lambda total, last=None, **more: {"type": "event_msg", "timestamp": "2026-01-01T00:00:00Z", "payload": {"type": "token_count", "info": {"total_token_usage": total, "last_token_usage": last}, **more}}
    plain = [
        {"type": "session_meta", "payload": {"id": "s1", "cwd": "/w"}}, {"type": "turn_context", "payload": {"model": "m1", "service_tier": " fast "}}, count(usage(5, 1)), count(usage(5, 1)), "no json", count(usage(9, 3)),
        count(usage(2, 1)), {"type": "session_meta", "payload": {"id": "other", "cwd": "/other"}}, count(usage(4, 1), model="m2"), count(None, usage(7, 7)),
    ]
    forked = [{"type": "session_meta", "payload": {"id": "s2", "forked_from_id": "s1"}}, count(usage(5, 1))]
    single = [count(usage(5, 1)), {"type": "token_usage_record", "timestamp": "2026-01-01T00:00:00Z", "payload": {"usage": usage(1, 1)}}, count(usage(9, 1))]
    rows = [(f, i + 1, r if isinstance(r, str) else json.dumps(r)) for f, records in (("/a.jsonl", plain), ("/b.jsonl", forked), ("/c.jsonl", single)) for i, r in enumerate(records)]
    lines = spark.createDataFrame(rows, "file string, line long, value string")
    lines.coalesce(1).write.parquet(f"{tmp_path}/in")
    found = _run(spark, tmp_path, lines.schema).collect()
    a = sorted((r["line"], r["session_id"], r["raw_model"], r["project"], r["service_tier"], r["input_tokens"], r["output_tokens"]) for r in found if r["file"] == "/a.jsonl")
    assert a == [(3, "s1", "m1", "/w", "fast", 5, 1), (6, "s1", "m1", "/w", "fast", 4, 2), (7, "s1", "m1", "/w", "fast", 2, 1), (9, "s1", "m2", "/w", "fast", 2, 0), (10, "s1", "m1", "/w", "fast", 7, 7)]
    assert sorted((r["file"], r["line"], r["needs_batch"]) for r in found if r["file"] != "/a.jsonl") == [("/b.jsonl", 1, True), ("/c.jsonl", 1, False), ("/c.jsonl", 2, True)]


def _states(box):
    return {(r["device_id"], r["id"]): r["state"] for r in box.states().collect()}


def test_withdrawals_survive_a_failure_before_the_acknowledgement(spark, sf_dir, tmp_path):
    events = usage_events(spark, sf_dir).where("device_id <> 'dev-copy'")
    hub = store.create(spark, f"{tmp_path}/hub", events, buckets=4)
    gone = events.where("event_id % 10 = 0").select("device_id", "id")
    n, sent = gone.count(), []

    class Lost(Exception):
        pass

    def send(ids, number):
        sent.append(number)
        store.merge(hub, events.limit(0), number, ids)
        if len(sent) == 2:
            raise Lost  # the hub has it, and nobody knows

    box = outbox.Outbox(spark, f"{tmp_path}/outbox")
    outbox.withdraw(box, gone)
    outbox.withdraw(box, gone.limit(5))
    assert set(_states(box).values()) == {"pending"} and len(_states(box)) == n
    with pytest.raises(Lost):
        outbox.flush(box, send, portion=n // 3)
    assert set(_states(box).values()) == {"sent", "acknowledged"}
    outbox.flush(outbox.Outbox(spark, f"{tmp_path}/outbox"), send, portion=n // 3)
    assert set(_states(box).values()) == {"acknowledged"} and sent[1] == sent[2], "the same portion went out again"
    assert hub.rows().count() == events.count() - n and store.fingerprint(hub).first()["records"] == events.count() - n
    assert outbox.flush(box, send) == 0
    # an upload takes a withdrawal back, and the id may be withdrawn again
    again = gone.limit(4).collect()
    back = spark.createDataFrame(again, "device_id string, id string")
    outbox.restore(box, back)
    outbox.withdraw(box, gone)
    assert sorted(k for k, s in _states(box).items() if s == "pending") == sorted((r["device_id"], r["id"]) for r in again)
    before = _states(box)
    box.compact()
    assert len(box.steps()) == 1 and _states(box) == before


def test_portions_that_go_together_are_one_merge(spark, tmp_path):
    box, calls = outbox.Outbox(spark, f"{tmp_path}/outbox"), []
    outbox.withdraw(box, spark.range(40).selectExpr("concat('d', id % 3) AS device_id", "concat('i', id) AS id"))

    def send(ids, number):
        calls.append((number, sorted(r["id"] for r in ids.collect())))
        if len(calls) == 1:
            raise OSError

    with pytest.raises(OSError):
        outbox.flush(box, send, portion=10, together=True)
    assert set(_states(box).values()) == {"sent"}
    outbox.withdraw(box, spark.createDataFrame([("d", "new")], "device_id string, id string"))
    assert outbox.flush(box, send, portion=10, together=True) == 5
    assert len(calls) == 3 and calls[0] == calls[1] and len(calls[0][1]) == 40, "the same ids went out again under the same number"
    assert calls[2][1] == ["new"] and set(_states(box).values()) == {"acknowledged"}


def test_an_incomplete_step_does_not_count(spark, tmp_path):
    box = outbox.Outbox(spark, f"{tmp_path}/outbox")
    assert box.steps() == [] and box.states().count() == 0
    ids = spark.createDataFrame([("d", "a"), ("d", "b")], "device_id string, id string")
    outbox.withdraw(box, ids)
    (tmp_path / "outbox" / "step-000000000002").mkdir()
    assert box.steps() == [1]
    outbox.restore(box, ids.limit(1))
    assert sorted(_states(box).values()) == ["pending", "restored"]


def test_lines_wait_in_parts(spark, tmp_path):
    """A log's waiting lines are read and written one part at a time."""

    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Parts(dict):
        getValue, updateValue, removeKey = dict.get, dict.__setitem__, dict.pop

    counter = counters.Counter()
    counter.carry, counter.waiting = Value(), Parts()
    n = 5 * counters.PART + 3
    row = lambda i: {"file": "/f", "line": i, "ms": float(i), "meta": None, "batch": False, "session": None, "model": None, "cwd": None, "tier": None, "named": None, "total": np.full(7, i), "last": None, "of_file": "s"}
    run = lambda some: [r for out in counter.handleInputRows(("/f",), iter([pd.DataFrame([row(i) for i in part]) for part in some]), None) for r in out.itertuples()]
    late = list(range(n, 1, -1))
    assert run([late[: n // 2], late[n // 2 :]]) == []
    assert len(counter.waiting) == 6 and all(len(json.loads(v[0])) <= counters.PART for v in counter.waiting.values())
    found = run([[1, 1, 7]])
    assert [r.line for r in found] == list(range(1, n + 1)) and {tuple(r.tokens) for r in found} == {(1,) * 7}
    assert not counter.waiting and run([late]) == []
