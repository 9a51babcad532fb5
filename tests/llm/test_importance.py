import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from metergrid.llm import importance


def features(text, max_n=2):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10_000


def brute(docs, target):
    """{(id, text): (n_features, weight, score)} and the drawn ids in order."""
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, features(x)[1]))
    for x in target:
        t.update(map(bucket, features(x)[1]))
    big, wanted = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * big / ((s[b] + 1) * wanted))) for b in s}
    out, order = {}, []
    for i, x in docs:
        n, f = features(x)
        weight = sum(gain[bucket(g)] for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i, x] = (len(f), weight, score)
        if n >= 20:
            order.append((-score, i is None, i or 0))
    order.sort()
    return out, [(None if none else i, k + 1) for k, (_, none, i) in enumerate(order[: len(order) // 4])]


def test_suffix_array_runs():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))).encode() for _ in range(20)]
    words = importance.number_words(texts)
    for depth in (1, 2, 3, 5):
        order, lcp = importance.suffix_array(words, depth)
        assert sorted(order.tolist()) == list(range(len(words.ids)))
        suffix = lambda p: [words.ids[q] for q in range(p, min(p + depth, len(words.ids))) if words.owner[q] == words.owner[p]]  # noqa: B023, E731
        for k in range(1, len(order)):
            a, b = suffix(order[k - 1]), suffix(order[k])
            assert a <= b and lcp[k] == next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        for n in range(1, depth + 1):
            heads, run = importance.runs(words, order, lcp, n)
            grams = Counter(g for t in texts for g in features(t.decode(), n)[1] if len(g.split()) == n)
            assert len(heads) == len(grams) and sorted(np.bincount(run[run >= 0]).tolist()) == sorted(grams.values())


def test_features_of_longer_ngrams():
    texts = ["One two, three! one TWO three", "", "x", "ÄÖ ß 日本 x\x00y Z9"]
    for n in (1, 2, 4):
        found, owner, n_words = importance.feature_buckets([t.encode() for t in texts], n)
        for k, t in enumerate(texts):
            assert Counter(found[owner == k].tolist()) == Counter(bucket(f) for f in features(t, n)[1]) and n_words[k] == features(t)[0]


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["w%d" % k for k in range(40)]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for k in range(200)]
    docs += [(300 + k, docs[5][1]) for k in range(50)] + [(None, "w1 " * 30), (900, None), (901, ""), (902, "..."), (903, "w1 w2 " * 5000)]
    target = [" ".join(rng.choices(vocabulary[:8], k=30)) for _ in range(10)] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS rank", "text AS weight")
    rows = importance.draw(df, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    want, order = brute(docs, target)
    assert len(rows) == len(docs)
    assert all((r["n_features"], r["weight"], r["score"]) == want[r["doc_id"], r["text"]] for r in rows)
    assert sorted((r["rank"], r["doc_id"]) for r in rows if r["rank"]) == sorted((k, i) for i, k in order)


def test_ties_and_empty_tables(spark):
    same = spark.createDataFrame([(k, "word " * 25) for k in (4, 4, 4, 4, 9, None, None, None)], "doc_id long, text string")
    none = same.limit(0)
    found = importance.draw(same, none).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == [1, 2]
    assert importance.draw(none, same).count() == 0
    short = spark.createDataFrame([(1, "too short")], "doc_id long, text string")
    assert [r["rank"] for r in importance.draw(short, same).collect()] == [None]
