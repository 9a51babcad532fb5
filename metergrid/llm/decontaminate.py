"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items: every run of `window` consecutive words, or the whole
item where it is shorter. Patterns of one length form one searcher with three tables:

* shift: for a block of the last two words under the search position, how far the position can move without
  passing an occurrence (a block that is in no pattern moves it by length - block + 1 words);
* buckets: for each block that ends a pattern (shift 0), the patterns to test;
* the direct comparison of the words under the position with those patterns.

The tables of at most BLOCK_WINDOWS windows are broadcast; a larger benchmark is searched in as many
passes over the documents, one bounded block after the other, with the hits carried along in the rows. The rows are
written between passes, so that a worker holds the tables of one block only.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metergrid.llm.common import Scratch, arrow_map, text_bytes

#: Windows whose tables one broadcast may hold (about 0.5 KB each in a worker).
BLOCK_WINDOWS = 100_000

#: Maximal runs of digits, letters a-z and anything beyond ASCII, after lower-casing A-Z.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

SPAN = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


class Searcher:
    """Wu-Manber tables for patterns of one length in words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set]):
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.far = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set]] = {}
        for p, items in patterns.items():
            for end in range(self.block, self.length + 1):
                key, move = p[end - self.block : end], self.length - end
                if move < self.shift.get(key, self.far):
                    self.shift[key] = move
            self.bucket.setdefault(p[-self.block :], {})[p] = items

    def search(self, words: list[bytes]):
        """(first word, items) of each occurrence."""
        shift, far, n, length, at = self.shift.get, self.far, len(words), self.length, self.length - 1
        two = self.block == 2
        while at < n:
            key = (words[at - 1], words[at]) if two else (words[at],)
            move = shift(key, far)
            if move:
                at += move
                continue
            items = self.bucket[key].get(tuple(words[at - length + 1 : at + 1]))
            if items is not None:
                yield at - length + 1, items
            at += 1


def windows(text: bytes, window: int) -> set[tuple[bytes, ...]]:
    words = WORD.findall(text.lower())
    return {tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()


def searchers(items: list[tuple[str | None, str]], window: int) -> list[Searcher]:
    by_length: dict[int, dict[tuple[bytes, ...], set]] = {}
    for item, text in items:
        for w in windows(text.encode(), window):
            held = by_length.setdefault(len(w), {}).setdefault(w, set())
            if item is not None:
                held.add(item)
    return [Searcher(p) for _, p in sorted(by_length.items())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    carry: list[str] | None = None,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """The rows of docs with n_words (long), hits (word spans inside occurrences of benchmark windows, first and
    last word, merged and in order) and items (ids as strings, sorted, of the items with occurring windows).

    Null or wordless texts have no words, hits or items. Null or wordless items have no windows; an item without
    an id marks words but is not listed. Repeated items count once by id; repeated documents stay repeated.
    """
    spark = docs.sparkSession
    known = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    # a text of n bytes has n/2 words at most, so this bounds the windows of a block
    total = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // (2 * block_windows)))
    known = known.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    outputs = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", SPAN), T.StructField("items", T.ArrayType(T.StringType()))])
    out, tmp = docs, Scratch(spark)
    for block in range(blocks):
        rows = [(r["item"], r["text"]) for r in known.where(F.col("block") == block).select("item", "text").collect()]
        tables = spark.sparkContext.broadcast(searchers(rows, window))
        first = block == 0

        def make(tables=tables, first=first):
            found = tables.value

            def step(part: pa.RecordBatch):
                counts, hits, items = [], [], []
                before = None if first else (part.column("hits").to_pylist(), part.column("items").to_pylist())
                for row, text in enumerate(text_bytes(part.column(text_col))):
                    words = WORD.findall(text.lower())
                    spans, names = [], set()
                    for s in found:
                        for at, of in s.search(words):
                            spans.append((at, at + s.length - 1))
                            names |= of
                    if before:
                        spans += [(x["first"], x["last"]) for x in before[0][row]]
                        names |= set(before[1][row])
                    counts.append(len(words))
                    hits.append([{"first": a, "last": b} for a, b in merged(spans)])
                    items.append(sorted(names))
                return counts, hits, items

            return step

        last = block == blocks - 1
        kept = carry if last or carry is None else list(dict.fromkeys([*carry, text_col]))
        out = arrow_map(out, text_col, outputs, make, kept, reads=() if first else ("hits", "items"))
        if not last:
            out = tmp.written(out, "contaminated")
            tmp.drop(*[t for t in list(tmp.paths) if t is not out])
    return out


def n_hit():
    """Words inside hits, of the rows of find_contamination()."""
    return F.expr("aggregate(hits, 0L, (n, x) -> n + x.last - x.first + 1)")
