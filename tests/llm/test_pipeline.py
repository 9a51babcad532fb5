"""Each stage of the corpus pipeline against a brute-force version on its own input."""

import os
import re

import corpus_pipeline
import pytest
from metergrid.llm.common import read, written
from metergrid.llm.mixing import mix
from tests.llm.helpers import DOCS, components
from tests.llm.test_secrets import brute


@pytest.fixture(scope="module")
def kept(spark, larger_dir):
    """The table after each stage."""
    docs = read(spark, larger_dir, "documents")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, larger_dir), name)
        found.append(docs)
    return found


def _rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_language_keeps_clean_documents(kept):
    before, after = _rows(kept[0]), _rows(kept[1])
    assert kept[1].columns == kept[0].columns
    gone = [r for i, r in before.items() if i not in after]
    assert all(before[i]["text"] == r["text"] for i, r in after.items())
    varied = lambda t: len(set(t.split())) > 0.4 * len(t.split())
    assert not [r for r in gone if r["lang"] and len(r["text"] or "") >= 200 and re.match(r"[\w ,.]+$", r["text"]) and varied(r["text"])]
    assert not [r for r in after.values() if not any(c.isalpha() for c in r["text"] or "")]


FOREIGN = {
    "italian": "la casa era molto grande e il giardino pieno di fiori che i bambini raccoglievano ogni mattina prima di andare a scuola insieme ai loro amici del quartiere vicino al fiume",
    "dutch": "het huis stond aan de rand van het dorp en de kinderen speelden elke middag bij het water terwijl hun ouders op het land werkten tot de zon onderging achter de heuvels",
    "polish": "dom stał na skraju wsi a dzieci bawiły się codziennie nad wodą podczas gdy ich rodzice pracowali w polu aż słońce zaszło za wzgórza i wszyscy wracali do domu na kolację",
    "letters": "qzx vjk wqx zzkq xvvj kqwz jxqk vzzw qkxj wvqz xkjq zvwq kxzj qvwx jzkq xwvz qjkx zwvq kzxj vqwk",
}


def test_other_languages_go(spark, larger_dir):
    docs = read(spark, larger_dir, "documents")
    rows = [(-i, text * n, None, "s", 1) for i, text in enumerate(FOREIGN.values(), 1) for n in (4, 1)]
    planted = spark.createDataFrame(rows, DOCS)
    kept = corpus_pipeline.known_language(spark, docs.unionByName(planted), larger_dir)
    assert not kept.where("doc_id < 0").count()


def test_one_of_each_group_of_near_copies(kept):
    before, after = _rows(kept[1]), _rows(kept[2])
    assert kept[2].columns == kept[0].columns
    least = components([(i, r["text"]) for i, r in before.items()], 5, 80)
    assert set(after) == {i for i, c in least.items() if i == c}


def test_no_benchmark_passage_stays(spark, larger_dir, kept):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = set()
    for r in read(spark, larger_dir, "benchmark").collect():
        w = low(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    hit = lambda t: any(tuple(w[i : i + n]) in windows for w in [low(t)] for n in sizes for i in range(len(w) - n + 1))
    before, after = _rows(kept[2]), _rows(kept[3])
    assert kept[3].columns == kept[0].columns
    assert set(after) == {i for i, r in before.items() if not hit(r["text"])} and len(after) < len(before)


def test_secrets_are_replaced(kept):
    before, after = _rows(kept[3]), _rows(kept[4])
    assert kept[4].columns == kept[0].columns and set(before) == set(after)
    changed = 0
    for i, r in before.items():
        text, out, at = r["text"], "", 0
        for first, _, last, _ in brute(text):
            if first >= at:
                out += text[at:first] + "[secret]"
            at = max(at, last)
        assert after[i]["text"] == (out + text[at:] if at else text)
        changed += bool(at)
    assert changed


def test_mixing_draws_what_the_operator_says(kept):
    drawn = sorted((r["doc_id"], r["epoch"], r["block"]) for r in kept[5].collect())
    assert drawn == sorted((r["doc_id"], r["epoch"], r["block"]) for r in mix(kept[4]).collect())
    assert set(kept[0].columns) < set(kept[5].columns) and drawn


def test_odd_rows_and_empty_tables(spark, tmp_path):
    word = "some plain words that repeat here and there in a text "
    rows = [(1, word * 3, "en", "s", 1), (1, word * 3, "en", "s", 1), (2, None, None, None, None), (3, "", "en", None, 0), (None, "loose words without a name", None, "t", 1), (4, word * 3000, "en", "s", 9), (5, "token=abcdefgh plus other text words", "en", "t", 2)]
    bench = spark.createDataFrame([(None, None), ("a", "")], "item_id string, text string")
    for k, given in enumerate((rows, [])):
        sf = str(tmp_path / str(k))
        os.makedirs(sf)
        spark.createDataFrame(given, DOCS).selectExpr("*", "doc_id AS id", "text AS score", "text AS kept").write.parquet(f"{sf}/documents.parquet")
        bench.write.parquet(f"{sf}/benchmark.parquet")
        got = corpus_pipeline.run(spark, sf).collect()
        assert bool(got) == bool(given)
        if given:
            assert {r["doc_id"] for r in got} <= {1, 4, 5, None}
            assert not [r for r in got if "token=" in r["text"]]
