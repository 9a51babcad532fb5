import hashlib
import random

import pytest

from metergrid.llm.queries import op8_suffix
from metergrid.llm.suffix_dedup import cover_ranks, remove_repeated, sorted_suffixes
from tests.llm.helpers import prose, removed_bytes, spans


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = removed_bytes(docs, 50)
    got = {r["doc_id"]: r for r in op8_suffix(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, [(t, gone)] in want.items():
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(t), sum(gone), len(spans(gone)))
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_edges(spark):
    rng = random.Random(3)
    a, b = prose(rng, 40), "é" * 60
    rows = [
        (1, a), (2, "x" + a), (3, a[:49]), (4, "q" + a[10:60] + "z"), (5, None), (6, ""), (7, b), (8, b[:40] + "e"), (9, "a" * 4000), (10, "a" * 120), (11, "ab" * 400),
        (12, "ab" * 40), (13, a[:70] + a[5:90]), (14, a + a), (14, a), (None, a), (15, "a" * 49), (16, prose(rng, 60_000) + a),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS id", "doc_id AS g", "text AS body", "doc_id AS removed")
    want = removed_bytes([(i, (t or "").encode()) for i, t in rows if i is not None], 50)
    got = {}
    for r in remove_repeated(df).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], [(x["first"], x["last"]) for x in r["removed"]], bytes(r["kept"])))
    assert got.pop(None) == [(len(a), [], a.encode())]
    assert {i: sorted(x) for i, x in got.items()} == {
        i: sorted((len(t), spans(g), bytes(c for c, m in zip(t, g, strict=True) if not m)) for t, g in x) for i, x in want.items()
    }


@pytest.mark.parametrize("hot", [1 << 15, 20, 1])
def test_many_groups_and_buckets_equal_brute_force(spark, monkeypatch, hot):
    from metergrid.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "HOT_STRETCHES", hot)
    monkeypatch.setattr(suffix_dedup, "SORTED_STRINGS", 50)
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 2_000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 3_000)
    rng = random.Random(4)
    shared = [prose(rng, 30) for _ in range(4)]
    rows = [(i, " ".join([prose(rng, rng.randint(0, 30)), rng.choice(shared)[rng.randint(0, 40) :], prose(rng, 5, "ab")])) for i in range(60)]
    want = removed_bytes([(i, t.encode()) for i, t in rows], 50)
    got = {r["doc_id"]: [(x["first"], x["last"]) for x in r["removed"]] for r in remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: spans(x[0][1]) for i, x in want.items()}


def test_empty_table_and_short_length(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated(empty).collect() == []
    with pytest.raises(ValueError):
        remove_repeated(empty, length=10)


def test_suffix_order_equals_plain_sorting():
    import numpy as np

    rng = random.Random(5)
    for _ in range(20):
        parts = ["".join(rng.choice("ab") for _ in range(rng.randint(60, 150))).encode() for _ in range(4)]
        text, end = np.frombuffer(b"".join(parts), np.uint8), np.repeat(np.cumsum([len(p) for p in parts]), [len(p) for p in parts])
        at = np.concatenate([np.arange(e - len(p), e - 49) for p, e in zip(parts, np.cumsum([len(p) for p in parts]), strict=True)])
        order = sorted_suffixes(text, end, at, np.zeros(len(at), np.int64), 50)
        heads = [text[p : p + 50].tobytes() for p in at[order]]
        assert heads == sorted(heads)
        assert cover_ranks(text, end, 50).max() > 0
