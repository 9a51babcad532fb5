import random
import re
import tracemalloc

import pyarrow as pa
from metergrid.llm import neardup
from metergrid.llm.common import flat_bytes
from metergrid.llm.neardup import near_duplicates
from metergrid.llm.queries import op1_neardup
from pyspark.sql import types as T
from tests.llm.helpers import components, prose, shingle_set


def _result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = components(docs, 3, 85)
    got = _result(op1_neardup(spark, sf_dir))
    assert len(got) == len(docs)
    for i, t in docs:
        assert got[i] == (len(shingle_set(t, 3)), want[i], want[i] == i)


def test_edges_ties_and_clashing_names(spark):
    rng = random.Random(1)
    base = prose(rng, 60)
    words = base.split()
    near = " ".join(words[:-2] + ["other", "end"])
    rows = [
        (5, base, 1), (3, base.upper(), 2), (9, near, 3), (7, None, 4), (8, "", 5), (1, " \t\n", 6), (2, "two words", 7), (4, "Two\x0bwords", 8), (6, "two", 9),
        (10, "two two", 1), (None, base, 2), (11, prose(rng, 30_000), 3), (12, "x y z", 4),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept long").selectExpr("*", "kept AS id", "kept AS component_id", "text AS sig", "kept AS rep")
    found = near_duplicates(df, words=5, percent=80)
    got = {r["doc_id"]: r for r in found.collect()}
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = components([r[:2] for r in rows], 5, 80)
    for i, t, _ in rows:
        if i is None:
            assert got[i]["component_id"] is None and got[i]["kept"]
        else:
            assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(shingle_set(t, 5)), want[i], want[i] == i)
    assert got[9]["component_id"] == 3 and got[4]["component_id"] == 2


def test_repeated_rows_stay(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    rows = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect())
    assert rows == [(1, 1, True), (1, 1, True), (2, 1, False)]


def test_large_group_of_different_near_copies_is_one_component(spark):
    rng = random.Random(2)
    base = prose(rng, 80).split()
    rows = []
    for i in range(700):
        w = list(base)
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(rng, 50)) for i in range(60)]
    got = _result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    want = components(rows, 5, 80)
    assert {i: x[1] for i, x in got.items()} == want


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_words_that_defeat_a_running_hash_are_told_apart(spark):
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = [(1, word), (2, other), (3, f"x y {word}"), (4, f"x y {other}"), (5, f"x y {word}"), (6, word[:1024]), (7, other[:1024])]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=3, percent=85, shallow=4).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3, 6: 6, 7: 7}


class _Handed:
    """Stands for a DataFrame; what is handed to mapInArrow() runs here."""

    columns, schema = ["id", "text"], T.StructType().add("id", "long").add("text", "string")

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_a_worker_takes_little_and_gives_it_back(spark):
    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024
    rng = random.Random(4)
    words = prose(rng, 4_000).split()
    batch = lambda n: pa.RecordBatch.from_pydict({"id": list(range(n)), "text": [" ".join(rng.choices(words, k=300)) for _ in range(n)]})
    run = neardup.text_sets(_Handed(), "id", "text", 5)
    large = batch(6_000)
    list(run(iter([batch(10)])))
    before = held()
    for _ in run(iter([large, large])):
        pass
    del _
    assert held() - before < 25
    peak = lambda: tracemalloc.get_traced_memory()[1] / 1e6
    assert large.column("text").nbytes > 8e6
    tracemalloc.start()
    for _ in run(iter([large])):
        pass
    assert peak() < 70
    tracemalloc.reset_peak()
    got = neardup.sets_of(large.column("text"), 5)
    assert peak() < 100
    tracemalloc.stop()
    want = neardup.shingle_sets(*flat_bytes(large.column("text")), 5)
    assert all((a == b).all() for a, b in zip(got, want, strict=True))
