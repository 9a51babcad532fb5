"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds the vectors of its letters, each
permuted (rotated) by its place, through the elementwise product. A text's vector bundles (adds) the vectors of
its trigrams; a language's prototype bundles the unit vectors of its texts. The language of a text is the one
whose prototype has the largest cosine with the text's vector.

Letters are lower-cased; every run of other characters is one word boundary, and trigrams across a boundary
are not used. Numpy computes one slice of texts at a time: the counts of the slice's trigrams (texts x trigrams)
times the vectors of those trigrams, ROWS x GRAMS counts at once.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metergrid.llm.common import arrow_map, release, sliced

DIMS = 512
SEED = 20240817
#: Code points below this have letter vectors of their own; those above share LETTERS - OWN by remainder.
OWN, LETTERS = 0x250, 1024
UNKNOWN = "und"
#: Unit vectors are added as whole numbers of this size, so that sums don't depend on their order.
UNIT = 1 << 20
SLICE = 1 << 20
#: Short texts are many and those of many letters have many trigrams: the counts of a whole slice could take gigabytes.
ROWS, GRAMS = 512, 4096


@functools.cache
def letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), size=(LETTERS, DIMS))


@functools.cache
def letter_of() -> np.ndarray:
    """Code point of the first plane to letter number; 0 for what is no letter."""
    return np.array([0 if not chr(c).isalpha() else c if c < OWN else OWN + c % (LETTERS - OWN) for c in range(1 << 16)], np.int32)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text and the trigram of each place, by numbers, and (trigrams x 3) letters."""
    joined = " ".join(texts)
    points = np.frombuffer(f" {joined} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t.lower()) for t in texts]) if len(points) != len(joined) + 2 else np.fromiter(map(len, texts), np.int64, len(texts))
    letters = letter_of()[np.minimum(points, 0xFFFF)]
    for c in np.unique(points[points > 0xFFFF]):
        if chr(c).isalpha():
            letters[points == c] = OWN + c % (LETTERS - OWN)
    row = np.repeat(np.arange(len(texts) + 1), np.append(lengths + 1, 1))[: len(letters)]
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != 0) | (letters[:-1] != 0)
    letters, row = letters[keep], row[keep]
    used = np.flatnonzero(np.bincount(letters, minlength=1))
    code = np.zeros(LETTERS, np.int64)
    code[used] = np.arange(len(used))
    k, x = len(used), code[letters]
    middle = letters[1:-1] != 0
    grams, row = ((x[:-2] * k + x[1:-1]) * k + x[2:])[middle], row[1:-1][middle]
    if k <= 100:
        there = np.flatnonzero(np.bincount(grams, minlength=1))
        place = np.zeros(int(there[-1]) + 1 if len(there) else 1, np.int64)
        place[there] = np.arange(len(there))
        column = place[grams]
    else:
        there, column = np.unique(grams, return_inverse=True)
    return row, column, used[np.stack([there // (k * k), there // k % k, there % k], 1)]


def text_vectors(texts: list[str]) -> np.ndarray:
    """The bundle of each text, one row each; zeros where it has no letter."""
    row, column, grams = trigrams(texts)
    once, twice, table = np.roll(letter_vectors(), 1, axis=1), np.roll(letter_vectors(), 2, axis=1), letter_vectors()
    out = np.zeros((len(texts), DIMS), np.float32)
    for at in range(0, len(grams), GRAMS):
        a, b, c = grams[at : at + GRAMS].T
        bound = twice[a]
        bound *= once[b]
        bound *= table[c]
        here = (column >= at) & (column < at + GRAMS)
        texts_here, place = row[here], column[here] - at
        starts = np.searchsorted(texts_here, np.arange(0, len(texts) + ROWS, ROWS))
        for k, (i, j) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            first, n = k * ROWS, min(ROWS, len(texts) - k * ROWS)
            counts = np.bincount((texts_here[i:j] - first) * len(a) + place[i:j], minlength=n * len(a))
            out[first : first + n] += counts.reshape(n, len(a)).astype(np.float32) @ bound
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def split_texts(texts: list[str | None], most: int = 1 << 16) -> tuple[list[str], np.ndarray]:
    """Very long texts in pieces, so that a slice's count matrix stays small; the piece's text number."""
    pieces, owner = [], []
    for i, t in enumerate(texts):
        t = t or ""
        for at in range(0, max(1, len(t)), most):
            pieces.append(t[at : at + most])
            owner.append(i)
    return pieces, np.array(owner, np.int64)


def vectors_of(texts: list[str | None]) -> np.ndarray:
    pieces, owner = split_texts(texts)
    part = text_vectors(pieces)
    if len(pieces) == len(texts):
        return part
    out = np.zeros((len(texts), DIMS), np.float32)
    np.add.at(out, owner, part)
    return out


def fit_languages(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """The unit prototype of each language among all rows with text and language. A task adds its rows up, so
    that only sums leave it. Without such rows the model is empty and every text is `und`."""
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, lang_col)
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bundle", T.ArrayType(T.LongType()))])

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in sliced(batch, text_col, SLICE):
                vectors = np.rint(unit(vectors_of(part.column(text_col).to_pylist())) * UNIT).astype(np.int64)
                langs = np.array(part.column(lang_col).to_pylist(), object)
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0)
                del part, vectors, langs
            del batch
            release()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["lang", "bundle"])

    summed = rows.mapInArrow(run, schema).select("lang", F.posexplode("bundle")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    model: dict[str, np.ndarray] = {}
    for r in summed.collect():  # languages x DIMS numbers
        model.setdefault(r["lang"], np.zeros(DIMS))[r["pos"]] = r["x"]
    return {k: (v / n).astype(np.float32) for k, v in sorted(model.items()) if (n := np.linalg.norm(v)) > 0}


def predict_language(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The rows of docs with lang_pred (a language of the model; `und` for null texts, texts without a letter and an
    empty model) and score (double, the cosine with that prototype, 0 at least; 0 for `und`). Equal cosines go to
    the language that sorts first."""
    names = sorted(model)
    matrix = np.stack([model[x] for x in names], 1) if names else np.zeros((DIMS, 0), np.float32)
    held = docs.sparkSession.sparkContext.broadcast(matrix)
    outputs = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def make():
        prototypes = held.value

        def step(part: pa.RecordBatch):
            vectors = unit(vectors_of(part.column(text_col).to_pylist()))
            if not names:
                return [UNKNOWN] * len(vectors), [0.0] * len(vectors)
            cosines = vectors @ prototypes
            best = cosines.argmax(axis=1)
            known = vectors.any(axis=1)
            score = np.where(known, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0).astype(np.float64)
            return [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score

        return step

    return arrow_map(docs, text_col, outputs, make, carry, limit=SLICE)


#: Labelled rows of a length that give it a floor at least.
FLOOR_ROWS = 20


def length_class(text_col: str = "text"):
    """The number of doublings in a text's characters; 0 for a null or empty one."""
    return F.floor(F.log2(F.greatest(F.lit(1), F.coalesce(F.char_length(text_col), F.lit(0))))).cast("int")


def score_floors(rows: DataFrame, model: dict[str, np.ndarray], share: float = 0.45, text_col: str = "text", lang_col: str = "lang") -> dict[int, float]:
    """For each length class of texts the score below which a text is in none of the model's languages: `share` of the
    median of all labelled texts of this length, since short texts score less; below 256 characters, where scores scatter,
    a smaller share the shorter they are. Classes with fewer than FLOOR_ROWS take the median of the nearest class that
    has them, in proportion where that is longer; without any there are no floors."""
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col)
    scored = predict_language(rows, model, text_col).where("score > 0").groupBy(length_class(text_col).alias("size"))
    found = scored.agg(F.count("*").alias("n"), F.percentile_approx("score", 0.5, 10_000).alias("middle")).where(F.col("n") >= FLOOR_ROWS)
    middle = {r["size"]: r["middle"] for r in found.collect()}  # a row for each doubling
    near = {size: min(middle, key=lambda k: (abs(k - size), k)) for size in range(1, 64)} if middle else {}
    return {size: share * min(1.0, size / 8) * middle[k] * min(1.0, size / k) for size, k in near.items()}


def below_floor(floors: dict[int, float], text_col: str = "text", score_col: str = "score"):
    """True for rows of predict_language() that score less than their length's floor."""
    if not floors:
        return F.lit(False)
    table = F.create_map(*[F.lit(x) for pair in sorted(floors.items()) for x in pair])
    return F.col(score_col) < F.coalesce(F.try_element_at(table, length_class(text_col)), F.lit(0.0))
