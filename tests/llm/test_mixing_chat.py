import math

import pytest

from metergrid.llm import chat, mixing


def test_temperature_meets_entropy_and_repeats(spark):
    totals = spark.createDataFrame([("a", 9000), ("b", 900), ("c", 100)], "source string, tokens long")
    p = [0.9, 0.09, 0.01]

    def weights(a):
        raw = [x**a for x in p]
        return [w / sum(raw) for w in raw]

    a = mixing.temperature(totals, 0.8, 1e9)
    assert math.isclose(-sum(w * math.log(w) for w in weights(a)), 0.8 * math.log(3), rel_tol=1e-6)
    b = mixing.temperature(totals, 0.8, 2.0)
    assert b > a and math.isclose(max(w / x for w, x in zip(weights(b), p, strict=True)), 2.0, rel_tol=1e-6)
    assert mixing.temperature(totals, 0.1, 4.0) == 1.0


def test_many_sources_give_the_same_exponent(spark, monkeypatch):
    totals = spark.createDataFrame([(str(i), 10 + i * i) for i in range(30)], "source string, tokens long")
    want = mixing.temperature(totals, 0.97, 4.0)
    monkeypatch.setattr(mixing, "DRIVER_SOURCES", 5)
    monkeypatch.setattr(mixing, "STEPS", 12)
    assert mixing.temperature(totals, 0.97, 4.0) == pytest.approx(want, abs=1e-3)


def test_draws(spark):
    rows = [(i, "big", "x" * 40) for i in range(300)] + [(1000 + i, "small", "y" * 40) for i in range(30)] + [(2000, None, None), (2001, "", ""), (None, "small", "z" * 8), (5, "big", "x" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "doc_id AS n", "doc_id AS id", "doc_id AS block", "doc_id AS tokens")
    got = mixing.mix(df, entropy_share=0.7, block_tokens=500).collect()
    plan = {}
    for r in got:
        plan.setdefault((r["source"], r["epoch"]), []).append(r["doc_id"])
    for drawn in plan.values():
        assert len(drawn) == len(set(drawn))  # once an epoch
    tokens = sum(r["n_tokens"] for r in got)
    assert tokens <= 300 * 10 + 10 + 30 * 10 + 2 + 2 and tokens >= 0.95 * (301 * 10 + 30 * 10)
    assert len([r for r in got if r["source"] == "small"]) > 31
    sizes = {}
    for r in got:
        sizes[r["block"]] = sizes.get(r["block"], 0) + r["n_tokens"]
    assert set(sizes) == set(range(max(sizes) + 1)) and max(sizes.values()) <= 500 * 1.3
    assert mixing.mix(df.limit(0)).collect() == []


def test_snapshots_collapse(spark):
    rows = [
        ("a", 1, "user", "hi"), ("a", 2, "bot", "yo"), ("b", 1, "user", "hi"), ("b", 2, "bot", "yo"), ("b", 3, "user", "bye"), ("c", 1, "user", "hi"), ("c", 2, "bot", "yo"), ("c", 3, "user", "bye"),
        ("d", 1, "user", "hi"), ("d", 2, "bot", "other"), ("e", None, None, None), ("f", 1, "user", "hi"), ("f", 1, "user", "hi"), (None, 1, "user", "x"), ("g", 1, "us", "erhi"),
    ]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").selectExpr("*", "conv_id AS conv", "turn AS place", "text AS h", "text AS last")
    got = {r["conv"]: (r["n_turns"], r["chat"]) for r in chat.render(chat.maximal(df)).collect()}
    assert set(got) == {"b", "d", "e", "g"}
    assert got["b"] == (3, "<|user|>\nhi\n<|end|>\n<|bot|>\nyo\n<|end|>\n<|user|>\nbye\n<|end|>\n") and got["e"] == (1, "<||>\n\n<|end|>\n")
    assert chat.maximal(df.limit(0)).collect() == []


def test_long_turns_ties_and_markers(spark):
    long = "word " * 100_000
    rows = [("b", 1, "user", long), ("a", 1, "user", long), ("c", 1, "user", long), ("c", 1, "bot", "x"), ("d", None, "user", "first"), ("d", 1, "user", "<|end|>"), ("e", 1, "user", long + "!")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {r["conv"]: (r["n_turns"], r["chat"]) for r in chat.render(chat.maximal(df)).collect()}
    assert set(got) == {"a", "c", "d", "e"}  # of equal ones the smallest id; c begins with the bot's turn
    assert got["c"][1].startswith("<|bot|>\nx") and got["d"] == (2, "<|user|>\nfirst\n<|end|>\n<|user|>\n<|end|>\n<|end|>\n") and len(got["a"][1]) == len(long) + len("<|user|>\n\n<|end|>\n")


def test_a_source_of_several_spans_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOT_ROWS", 4)
    rows = [(i, "big", "x" * (4 + i % 7)) for i in range(400)] + [(1000, "small", "y" * 2_000_000), (1001, "small", "z")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, entropy_share=0.0).collect()
    plan = {}
    for r in got:
        plan.setdefault((r["source"], r["epoch"]), []).append(r["doc_id"])
    assert sorted(plan["big", 0]) == list(range(400)) and sorted(plan["small", 0]) == [1000, 1001]
