"""Importance resampling towards a target distribution of hashed n-grams.

Texts and target texts are bags of n-grams, each hashed to one of BUCKETS buckets. The gain of a bucket is the logarithm of
its smoothed share in the target over its share in the corpus; a document's weight is the mean gain of its n-grams, and
documents are drawn without replacement by weight plus Gumbel noise that depends on seed and id.

N-grams are enumerated from suffix arrays of word ids. A task numbers the words of a slice of texts and sorts the positions
by the words that follow, max_n words deep and never beyond the text's end. Between neighbours in that order stands the
length of their common prefix; for each n, the positions of an n-gram are one run of neighbours that agree in n words.
A run's n-gram is hashed once, and its bucket is scattered to all positions of the run. So a repeated n-gram costs one hash
a slice, and words are spelled out once a run.

What leaves the tasks has a fixed size: bucket counts, and a row of numbers for each document. Ranks come from counts of
whole scores, of which there are less than MOST_SCORES, so that no task sorts more than the documents of one score.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metergrid.llm.common import arrow_map, sliced, text_bytes, written

BUCKETS = 10_000
MAX_N = 2
SEED = 7
LEAST_WORDS = 20
PERCENT = 25
#: Gains and noise are logarithms of ratios of 64-bit counts in thousandths: between -90,000 and 90,000, and -4,000 and 23,000.
MOST_SCORES = 220_000

_WORD = np.ones(256, bool)
_WORD[0x00:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False  # bytes of words, after A-Z is in lower case
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass
class Words:
    """The words of some texts one after the other: their numbers, the text each is of, and the spelling of each number."""

    ids: np.ndarray
    owner: np.ndarray
    spelled: list[bytes]


def number_words(texts: list[bytes]) -> Words:
    """Words are compared as bytes; their numbers follow from the order in which they occur."""
    seen: dict[bytes, int] = {}
    ids: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    blank = bytes(b if _WORD[b] else 32 for b in _LOWER)  # one table: lower case, and a blank for what is no word
    for k, text in enumerate(texts):
        found = text.translate(blank).split()
        counts[k] = len(found)
        ids += [seen.setdefault(w, len(seen)) for w in found]
    return Words(np.array(ids, np.int64), np.repeat(np.arange(len(texts)), counts), list(seen))


def suffix_array(words: Words, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by the `depth` words that start there (fewer at a text's end, which sorts first), and for each
    place in that order the number of words that it shares with the place before, `depth` at most."""
    n = len(words.ids)
    columns = []
    for k in range(depth):
        column = np.full(n, -1, np.int64)
        inside = words.owner[k:] == words.owner[: n - k]
        column[: n - k][inside] = words.ids[k:][inside]
        columns.append(column)
    order = np.lexsort(columns[::-1])
    lcp, same = np.zeros(n, np.int64), np.ones(max(n - 1, 0), bool)
    for column in columns:
        sorted_column = column[order]
        same &= (sorted_column[1:] == sorted_column[:-1]) & (sorted_column[1:] >= 0)
        lcp[1:] += same
    return order, lcp


def runs(words: Words, order: np.ndarray, lcp: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the n-grams: the first position of each run, and for each place of the order the run that it is in (-1: the text
    ends within n words)."""
    size = len(order)
    whole = np.zeros(size, bool)
    last = order + n - 1
    fits = last < size
    whole[fits] = words.owner[last[fits]] == words.owner[order[fits]]
    begins = whole & (lcp < n)
    return order[begins], np.where(whole, np.cumsum(begins) - 1, -1)


def feature_buckets(texts: list[bytes], max_n: int = MAX_N, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket and the text of every n-gram occurrence of 1 to max_n words, and the number of words of each text."""
    words = number_words(texts)
    order, lcp = suffix_array(words, max_n)
    n_words = np.bincount(words.owner, minlength=len(texts))
    found, owners = [], []
    for n in range(1, max_n + 1):
        heads, run = runs(words, order, lcp, n)
        table = [words.ids[heads + k].tolist() for k in range(n)]
        # one hash a run
        hashed = [zlib.crc32(b" ".join([words.spelled[w] for w in gram])) for gram in zip(*table, strict=True)]
        inside = run >= 0
        # scattered to all places of the run
        found.append(np.array(hashed, np.int64)[run[inside]] % buckets if len(hashed) else np.zeros(0, np.int64))
        owners.append(words.owner[order[inside]])
    return np.concatenate(found), np.concatenate(owners), n_words


def bucket_counts(texts: DataFrame, text_col: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-gram occurrences of all texts each bucket holds: an array of `buckets` numbers, from one row of counts a
    task, summed by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in sliced(batch, text_col):
                total += np.bincount(feature_buckets(text_bytes(part.column(text_col)), max_n, buckets)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": held, "n": total[held]})

    rows = texts.select(F.col(f"`{text_col}`")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths, rounded down."""
    size, total, wanted = len(corpus), float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((float(target[b]) + 1) * total / ((float(corpus[b]) + 1) * wanted))) for b in range(size)], np.int64)


def noise(row_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, rounded down, from seed and id alone (a null id is written as no digits)."""
    h = int.from_bytes(hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).digest()[:4])
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(
    docs: DataFrame, gain: np.ndarray, text_col: str = "text", id_col: str = "doc_id", seed: int = SEED, max_n: int = MAX_N, carry: list[str] | None = None
) -> DataFrame:
    """The rows of docs with n_words, n_features, weight (mean gain, rounded down; 0 without features) and score."""
    outputs = T.StructType().add("n_words", "long").add("n_features", "long").add("weight", "long").add("score", "long")
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def make() -> Callable:
        def step(part: pa.RecordBatch):
            found, owner, n_words = feature_buckets(text_bytes(part.column(text_col)), max_n, len(held.value))
            n = np.bincount(owner, minlength=part.num_rows)
            total = np.zeros(part.num_rows, np.int64)
            np.add.at(total, owner, held.value[found])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            return n_words, n, weight, weight + np.array([noise(i, seed) for i in part.column(id_col).to_pylist()], np.int64)

        return step

    return arrow_map(docs, text_col, outputs, make, carry, reads=(id_col,))


def resample(scored: DataFrame, id_col: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows with `rank`: 1 for the highest score of the floor(percent / 100 * eligible) that are drawn, null for the others.
    Rows of at least `least_words` words are eligible. Ties go to the smaller id; null ids come last, and equal ids in any
    order. `scored` is read three times, so it should be a table."""
    eligible = F.col("n_words") >= least_words
    by_score = scored.where(eligible).groupBy("score").agg(F.count("*").alias("n")).collect()
    assert len(by_score) <= MOST_SCORES
    quota = sum(r["n"] for r in by_score) * percent // 100
    starts, before = [], 0
    for r in sorted(by_score, key=lambda r: -r["score"]):
        if before >= quota:
            break
        starts.append((r["score"], before))
        before += r["n"]
    drawable = eligible & (F.col("score") >= starts[-1][0]) if starts else F.lit(False)
    offsets = scored.sparkSession.createDataFrame(starts, "score long, before long")
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last()))
    top = scored.where(drawable).join(F.broadcast(offsets), "score").withColumn("rank", F.col("before") + place)
    top = top.withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    rest = scored.where(~F.coalesce(drawable, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return top.select(*scored.columns, "rank").union(rest.select(*scored.columns, "rank"))


def draw(docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """The rows of docs (of the columns in `carry`, by default all) with n_words, n_features, weight, score and rank, drawn
    towards the texts of `target`. Rows aren't dropped: take those with a rank. Texts that are null or hold no word have no
    features; without documents or target texts gains are those of the empty counts."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, text_col))
    return resample(written(score(docs, gain, text_col, id_col, carry=carry), "importance"), id_col)
