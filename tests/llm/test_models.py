"""Language ID and quality: held-out accuracy, and defined results for odd rows."""

import random
import tracemalloc

import numpy as np

from metergrid.llm import langid, quality
from metergrid.llm.queries import op3_language, op6_quality


def test_language_of_held_out_documents(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op3_language(spark, sf_dir).collect()
    assert len(got) == len(docs)
    tested = [(r["lang_pred"] == docs[r["doc_id"]]["lang"]) for r in got if r["held_out"] and docs[r["doc_id"]]["lang"] and len((docs[r["doc_id"]]["text"] or "").split()) >= 5]
    assert len(tested) >= 20 and np.mean(tested) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    learn = [(1, "the house and the garden with the trees", "en"), (2, "das haus und der garten mit den bäumen", "de"), (3, None, "de"), (4, "word", None), (None, "der und die", "de")]
    model = langid.fit_languages(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    assert sorted(model) == ["de", "en"]
    rows = [(1, "the garden"), (1, "the garden"), (2, "der garten und"), (3, None), (4, ""), (5, "123 !? 😀"), (6, "𝔥𝔞𝔲𝔰"), (7, "das haus " * 50_000), (None, "the trees")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS score", "text AS lang_pred", "text AS lang")
    found = langid.predict_language(df, model)
    assert sorted(found.columns) == ["doc_id", "lang", "lang_pred", "score", "text"]
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in found.collect()]
    named = {i: p for i, p, _ in got}
    assert len(got) == 9 and named[1] == "en" and named[2] == named[7] == "de" and named[None] == "en"
    assert [named[i] for i in (3, 4, 5)] == ["und"] * 3 and all(s == 0 for i, p, s in got if p == "und") and named[6] != "und"
    empty = langid.fit_languages(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in langid.predict_language(df, empty).collect()} == {"und"}
    assert langid.predict_language(df.limit(0), model).collect() == []


def test_a_model_learns_from_every_row(spark):
    """Each of thirty languages has one text among 40,000."""
    learn = spark.range(40_000).selectExpr("id AS doc_id", "'the house' AS text", "if(id % 1000 = 7 AND id < 30000, concat('l', id div 1000), 'en') AS lang")
    assert len(langid.fit_languages(learn)) == 31


def test_bundles_follow_the_definition():
    table = langid.letter_vectors()
    a, b, c = (table[ord(x)] for x in "abc")
    want = np.roll(table[0], 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * c + np.roll(b, 2) * np.roll(c, 1) * table[0]
    assert np.array_equal(langid.text_vectors(["ABC"])[0], want)
    texts = ["first text", "", "another one, with words", "x"]
    together, alone = langid.text_vectors(texts), np.concatenate([langid.text_vectors([t]) for t in texts])
    assert np.array_equal(together, alone)


def test_quality_of_held_out_documents(spark, larger_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{larger_dir}/labels.parquet").collect()}
    got = op6_quality(spark, larger_dir).collect()
    assert len(got) == spark.read.parquet(f"{larger_dir}/documents.parquet").count()
    good = [r["score"] for r in got if r["held_out"] and labels.get(r["doc_id"]) == 1]
    bad = [r["score"] for r in got if r["held_out"] and labels.get(r["doc_id"]) == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(good) >= 10 and len(bad) >= 10 and auc >= 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_quality_edges(spark):
    learn = [(i, f"a calm and careful sentence about topic {i} in the archive", 1) for i in range(40)] + [(100 + i, f"BUY NOW {i} CLICK $$$ free free", 0) for i in range(40)]
    learn += [(200, None, 1), (201, "x", None), (202, "y", 7), (None, "a careful sentence", 1)]
    model = quality.fit_quality(spark.createDataFrame(learn, "doc_id long, text string, quality int"))
    rows = [(1, "a careful sentence about the archive"), (2, "CLICK NOW free $$$"), (3, None), (4, ""), (5, "a calm sentence about topic " * 20_000), (5, "z"), (None, "free free BUY")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS score", "doc_id AS predicted", "text AS quality")
    got = quality.score_quality(df, model).collect()
    score = {r["text"]: r["score"] for r in got}
    assert len(got) == len(rows) and score[rows[0][1]] > score[rows[1][1]] and score[None] == score[""] and 0 <= score[None] <= 1
    constant = quality.fit_quality(spark.createDataFrame([(1, "only good", 1)], "doc_id long, text string, quality int"))
    assert len({r["score"] for r in quality.score_quality(df, constant).collect()}) == 1
    assert quality.score_quality(df.limit(0), model).collect() == []


def test_quality_learns_from_all_of_a_text(spark):
    """Texts that differ only after their first 12,000 bytes, in all but the opening of each."""
    rng = np.random.default_rng(5)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    tails = ["a calm and careful sentence about the archive of the town. ", "BUY NOW click here for free $$$ and win a prize today! "]
    learn = [(i, words(1_800) + " " + tails[i % 2] * 200, 1 - i % 2) for i in range(120)]
    model = quality.fit_quality(spark.createDataFrame(learn, "doc_id long, text string, quality int"))
    assert tails[0].encode() in model.good and tails[1].encode() in model.bad
    assert tails[0].encode() not in model.bad and tails[1].encode() not in model.good
    got = quality.score_quality(spark.createDataFrame([(1, tails[0] * 9), (2, tails[1] * 9)], "doc_id long, text string"), model)
    score = {r["doc_id"]: r["score"] for r in got.collect()}
    assert score[1] > 0.9 and score[2] < 0.1


def test_many_short_texts_of_many_letters_take_little_memory():
    rng = random.Random(5)
    long = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(300)) for _ in range(100)]
    texts = [*long, *["the house", "", "x", "\U0001f600"] * 400]
    tracemalloc.start()
    got = langid.vectors_of(texts)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 100
    assert all((got[i] == langid.vectors_of([texts[i]])[0]).all() for i in [*range(100), *range(100, len(texts), 97)])
