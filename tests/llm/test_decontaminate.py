import random

from metergrid.llm.decontaminate import find_contamination
from tests.llm.helpers import prose

ITEMS = "item_id string, text string"


def _got(df):
    return {r["doc_id"]: ([(x["first"], x["last"]) for x in r["hits"]], list(r["items"]), r["n_words"]) for r in df.collect()}


def test_edges_and_clashing_names(spark):
    ten = "One two three four five six seven eight nine ten"
    items = [("a", ten + " eleven"), ("b", "short item"), ("c", None), ("d", "..."), ("b", "short item"), (None, "nameless words here"), ("e", "ÄÖ straße")]
    docs = [
        (1, "zero " + ten.upper() + ", eleven twelve"), (2, "one two three four five six seven eight nine"), (3, "a short, item; and short item"), (4, None), (5, ""),
        (6, "see nameless words here"), (7, "ÄÖ straße"), (8, "äö straße"), (9, "short\x00item " * 3), (9, "short"), (None, "short item"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "text AS hits", "doc_id AS items", "doc_id AS item", "1 AS block")
    found = find_contamination(df, spark.createDataFrame(items, ITEMS))
    assert set(found.columns) == {"doc_id", "text", "item", "block", "n_words", "hits", "items"}
    rows = [(r["doc_id"], [(x["first"], x["last"]) for x in r["hits"]], list(r["items"]), r["n_words"]) for r in found.collect()]
    want = [
        (1, [(1, 11)], ["a"], 13), (2, [], [], 9), (3, [(1, 2), (4, 5)], ["b"], 6), (4, [], [], 0), (5, [], [], 0), (6, [(1, 3)], [], 4), (7, [(0, 1)], ["e"], 2),
        (8, [], [], 2), (9, [(0, 5)], ["b"], 6), (9, [], [], 1), (None, [(0, 1)], ["b"], 2),
    ]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_blocks_of_a_large_benchmark_give_the_same(spark):
    rng = random.Random(6)
    items = [(f"i{k}", prose(rng, rng.randint(1, 30), "abc")) for k in range(80)]
    docs = [(k, prose(rng, 40, "abc") + " " + rng.choice(items)[1] + " " + prose(rng, 3)) for k in range(40)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    one = _got(find_contamination(d, b))
    assert one == _got(find_contamination(d, b, block_windows=700)) and any(x[0] for x in one.values())
    want = {}
    for i, t in docs:
        words, hit, names = t.split(), set(), set()
        for name, text in items:
            w = text.split()
            for k in range(max(1, len(w) - 9)):
                p = w[k : k + 10]
                for at in range(len(words) - len(p) + 1):
                    if words[at : at + len(p)] == p:
                        hit |= set(range(at, at + len(p)))
                        names.add(name)
        want[i] = (hit, sorted(names))
    assert {i: ({k for a, z in x[0] for k in range(a, z + 1)}, x[1]) for i, x in one.items()} == want


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert _got(find_contamination(docs, none)) == {1: ([], [], 2)}
    assert find_contamination(docs.limit(0), none).collect() == []
