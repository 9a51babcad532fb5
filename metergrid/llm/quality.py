"""Quality classifier by compression.

Two zstandard dictionaries are built, one from texts labelled good and one from texts labelled bad: raw content,
blocks chosen by a hash from the whole length of the texts, as many as fit. A text is compressed with each, in blocks of BLOCK bytes so that a long text stays
comparable with the dictionaries rather than with itself. The feature is the normalised difference (size with bad - size with good) / length of the
text in bytes; a logistic curve, fitted on labelled texts that the dictionaries have not seen, turns it into the
probability of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metergrid.llm.common import arrow_map, bounded_sample, text_bytes, written

#: Labelled rows that a model is learnt from at most; each is used in whole.
TRAIN_ROWS = 6_000
#: Bytes of a block of a dictionary, and of what is compressed at once.
BLOCK = 512
DICT_BYTES = 112_640
LEVEL = 6
THRESHOLD = 0.7


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


def dictionary(rows: DataFrame) -> bytes:
    """One block of every row's text, then a second one, and so on, until the dictionary is full; a hash of id and place
    orders the blocks of a text, and the texts. A block and its line break have two bytes at least, so the driver gets
    as many blocks as could be needed."""
    raw = rows.select("id", F.encode("text", "UTF-8").alias("raw")).where(F.octet_length("raw") > 0)
    cut = f"transform(sequence(0, octet_length(raw) - 1, {BLOCK}), i -> struct(xxhash64('block', id, i) AS order, substring(raw, i + 1, {BLOCK}) AS block))"
    blocks = raw.select(F.posexplode(F.array_sort(F.expr(cut))).alias("turn", "b")).select("turn", "b.order", "b.block")
    chosen = blocks.orderBy("turn", "order", "block").limit(DICT_BYTES // 2)
    return b"\n".join(bytes(r["block"]) for r in chosen.collect())[:DICT_BYTES]


def compressor(data: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(data) >= 8 else None
    if held:
        held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False, write_checksum=False)


def feature(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    if not text:
        return 0.0
    difference = 0
    for at in range(0, len(text), BLOCK):
        block = text[at : at + BLOCK]
        difference += len(bad.compress(block)) - len(good.compress(block))
    return difference / len(text)


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method, with a little shrinkage of the slope."""
    if len(x) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return 0.0, float(np.log(share / (1 - share)))
    design, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    ridge = np.diag([1e-3, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ w)
        w += np.clip(step, -20, 20)
        if abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit_quality(rows: DataFrame, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id", max_rows: int = TRAIN_ROWS) -> Model:
    """Learns from rows with a text and label 0 or 1; max_rows / 2 of each label at most, chosen by a hash of the
    id. Half of them, by another hash, make the dictionaries; the others fit the curve, on whole texts like those that
    are scored. Texts stay on the executors. Without rows of both labels the score is a constant."""
    rows = rows.where(F.col(text_col).isNotNull() & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")
    )
    bad_rows, good_rows = (bounded_sample(rows.where(F.col("label") == label), "id", max_rows // 2) for label in (0, 1))
    held = written(bad_rows.union(good_rows).withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2))), "labelled")
    good, bad = (dictionary(held.where((F.col("label") == label) & (F.col("half") == 0))) for label in (1, 0))
    outputs = T.StructType([T.StructField("x", T.DoubleType())])

    def make():
        a, b = compressor(good), compressor(bad)
        return lambda part: [[feature(t, a, b) for t in text_bytes(part.column("text"))]]

    points = sorted((r["label"], r["x"]) for r in arrow_map(held.where("half = 1"), "text", outputs, make, ["label"]).collect())
    x, y = (np.array([p[k] for p in points], float) for k in (1, 0))
    return Model(good, bad, *calibrate(x, y))


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The rows of docs with size_difference (double; 0 for null or empty texts), score (double, 0 to 1: the
    probability of label 1) and predicted (int, 1 if score >= 0.7)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    outputs = T.StructType([T.StructField("size_difference", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def make():
        m = held.value
        good, bad = compressor(m.good), compressor(m.bad)

        def step(part):
            x = np.array([feature(t, good, bad) for t in text_bytes(part.column(text_col))])
            score = 1 / (1 + np.exp(-np.clip(m.slope * x + m.offset, -30, 30)))
            return x, score, (score >= THRESHOLD).astype(np.int32)

        return step

    return arrow_map(docs, text_col, outputs, make, carry)
