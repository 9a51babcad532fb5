"""Language-model scores from a log-frequency Bloom filter.

Counts of all n-grams of 1 to `order` tokens of the training texts are quantised on a logarithmic scale: a count c has the
level 1 + floor(log c / log BASE), and an n-gram of level l enters the filter as the l pairs (n-gram, 1) ... (n-gram, l).
Probing (n-gram, 1), (n-gram, 2), ... until one is absent gives the level back, never too low, and too high at the rate of
false positives; the estimate of the count is the mean of the level's range. A text's tokens are its words and one end; a
start mark stands before them as context. The probability of a token is interpolated over orders,

    p_1 = (c(w) + ADD) / (N + ADD * (V + 1)),    p_n = (min(c(h w), c(h), c(h' w)) + m_n * p_(n-1)) / (c(h) + m_n),

with h the n-1 tokens before w and h' all but the first of them. The masses m_n are those of a grid of powers of two under
which the training texts, each token left out of the counts in turn, are likeliest.

The filter grows with the corpus. It consists of segments, one for each bucket of n-gram hashes, with BITS bits a pair; the
number of buckets follows from the number of tokens, so a segment has a bounded size whatever the corpus. Each is built in
one task from the sorted hashes that tasks have counted beforehand. Segments are broadcast in blocks of `block_bytes` at
most, and each block takes one pass over the texts that fills in the levels of the n-grams in it. All blocks are applied, so
levels don't depend on the size of blocks, but a corpus with a filter of many blocks takes as many passes.

Exact word counts, for the add-ADD score without the model, are joined: words that make up at least 1/HOT of all tokens, HOT
of them at most, are broadcast; of the others no key of the join can hold more rows than a share of 1/HOT. Words of more than
LONG bytes are told by their SHA-256.

Every row gives one row. A null text is the empty text, whose one token is the end. Without training texts every count is 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metergrid.llm.common import Scratch, arrow_map, flat_bytes, release, sliced, whole_groups, written
from metergrid.llm.shingles import mixed, word_hashes

ORDER = 2
BASE = 1.5
BITS, PROBES = 12, 5
#: Bits of a line of the filter, which holds all places of a pair; n-grams that are looked up together.
LINE, CHUNK = 512, 1 << 15
ADD = 0.1
HOT = 1 << 20
LONG = 64
#: Tokens of the corpus for each bucket, n-grams that a task holds before it sends them on, bytes of the filter in one broadcast.
BUCKET_TOKENS, HELD_GRAMS, BLOCK_BYTES = 1 << 18, 1 << 21, 128 << 20
#: Bytes of text, and of levels, that one step takes: a byte of text costs some twenty in arrays, a level some eighty.
TEXT_BYTES, LEVEL_BYTES = 1 << 20, 1 << 20
#: Bytes of an n-gram's hash within its bucket.
KEY = 5
END = ""
MASSES = [2.0**k for k in range(19)]

#: The least count of each level.
LEAST = np.unique(np.ceil(BASE ** np.arange(106)).astype(np.int64))
ESTIMATE = np.concatenate([[0.0], (LEAST[:-1] + LEAST[1:] - 1) / 2])
U = np.uint64
HALF = U(0xFFFFFFFF)
START_HASH, END_HASH = U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)


@dataclass
class Model:
    order: int
    n_tokens: int
    n_types: int
    vocabulary: DataFrame
    hot: dict[str, int]
    segments: DataFrame
    buckets: int
    per_block: int
    blocks: int


@dataclass
class Block:
    """The segments of consecutive buckets: where each begins in `bits`, and its number of lines."""

    first: int
    begins: np.ndarray
    sizes: np.ndarray
    bits: np.ndarray


@dataclass
class Tokens:
    """The words of a slice: the place of each in `spelled`, and the row that it is in."""

    codes: np.ndarray
    owner: np.ndarray
    spelled: pa.Array
    rows: int


def tokenise(texts: pa.Array) -> Tokens:
    kind = pa.large_string() if pa.types.is_large_string(texts.type) else pa.string()
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, pa.scalar("", kind))))
    flat, owner = pc.list_flatten(lists), np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(full).dictionary_encode()
    spelled = coded.dictionary.cast(pa.string())
    if (pc.max(pc.binary_length(spelled)).as_py() or 0) > LONG:
        words = spelled.cast(pa.binary()).to_pylist()
        spelled = pa.array([w if len(w) <= LONG else b" " + hashlib.sha256(w).hexdigest().encode() for w in words], pa.binary()).cast(pa.string())
    return Tokens(np.asarray(coded.indices).astype(np.int64), owner[np.asarray(full)], spelled, len(texts))


def sequences(tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of start, words and end of all rows one after the other, and the rows + 1 offsets; the hash of each distinct
    token, and its place among them for each position."""
    counts = np.bincount(tokens.owner, minlength=tokens.rows) + 2
    offsets = np.concatenate([[0], np.cumsum(counts)])
    data, at = flat_bytes(tokens.spelled)
    hashes = np.concatenate([word_hashes(data, at[:-1], at[1:]), [START_HASH, END_HASH]]).astype(U)
    place = np.full(offsets[-1], len(hashes) - 1)
    place[offsets[:-1]] = len(hashes) - 2
    place[np.arange(len(tokens.codes)) + 2 * tokens.owner + 1] = tokens.codes
    return hashes[place], offsets, hashes, place


def grams(seq: np.ndarray, offsets: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n of 1 to order the hashes of the n-grams and the positions where they start."""
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(seq))  # tokens from here to the end of the row
    found, held = [], mixed(seq + U(1))
    for n in range(1, order + 1):
        if n > 1:
            held = held[:-1] if len(held) else held
            held = mixed(held ^ mixed(seq[n - 1 :] * U(2 * n + 1))) if len(seq) >= n else np.zeros(0, U)
        at = np.flatnonzero(left[: len(held)] >= n)
        found.append((held[at], at))
    return found


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """By the upper half of the hash, in its order."""
    return ((hashes >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def key_of(hashes: np.ndarray) -> np.ndarray:
    return hashes & U((1 << 8 * KEY) - 1)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEAST, counts, side="right")


def probes(keys: np.ndarray, buckets: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where (n-gram, level) is: 32 bits that choose a line of LINE bits, and 64 bits from which the places in it come."""
    h = mixed(keys * U(2 * level + 1) ^ mixed(buckets.astype(U) + U(level)))
    return h & HALF, mixed(h)


def place_of(within: np.ndarray, i: int) -> np.ndarray:
    return (within >> U(9 * i)) & U(LINE - 1)


def segment(keys: np.ndarray, counts: np.ndarray, bucket: int) -> tuple[int, np.ndarray]:
    """Lines and bytes of the filter of a bucket."""
    level = levels_of(counts)
    lines = max(1, -(-BITS * int(level.sum()) // LINE))
    bits = np.zeros(lines * LINE, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        some = keys[level >= j]
        line, within = probes(some, np.full(len(some), bucket), j)
        first = (line * U(lines) >> U(32)) * U(LINE)
        for i in range(PROBES):
            bits[(first + place_of(within, i)).astype(np.int64)] = True
    return lines, np.packbits(bits, bitorder="little")


def probe(hashes: np.ndarray, block: Block, buckets: int) -> np.ndarray:
    """The levels of n-grams, 0 for those of other blocks. Few enough at a time that their lines stay in the cache."""
    out = np.zeros(len(hashes), np.uint8)
    for begin in range(0, len(hashes), CHUNK):
        part = hashes[begin : begin + CHUNK]
        bucket = bucket_of(part, buckets)
        at = np.flatnonzero((bucket >= block.first) & (bucket < block.first + len(block.sizes)))
        bucket, key = bucket[at], key_of(part[at])
        lines, first = block.sizes[bucket - block.first].astype(U), block.begins[bucket - block.first]
        ok = lines > 0
        for j in range(1, len(LEAST)):
            at, bucket, key, lines, first = (x[ok] for x in (at, bucket, key, lines, first))
            if not len(at):
                break
            line, within = probes(key, bucket, j)
            byte = first + ((line * lines >> U(32)) * U(LINE // 8)).astype(np.int64)
            ok = np.ones(len(at), bool)
            for i in range(PROBES):
                place = place_of(within, i)
                ok &= (block.bits[byte + (place >> U(3)).astype(np.int64)] >> (place & U(7)).astype(np.uint8)) & 1 > 0
            out[begin + at[ok]] = j
    return out


def _words(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sliced(batch, text_col, 4 * TEXT_BYTES):
            t = tokenise(part.column(text_col))
            n = np.append(np.bincount(t.codes, minlength=len(t.spelled)), t.rows)
            yield pa.RecordBatch.from_pydict({"word": pa.concat_arrays([t.spelled, pa.array([END], pa.string())]), "n": pa.array(n, pa.int64())})
            del t, n, part
        del batch
        release()


def count_words(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, count) of all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _words(batches, text_col)

    return texts.select(F.col(f"`{text_col}`")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("count"))


def count_grams(texts: DataFrame, text_col: str, order: int, buckets: int) -> DataFrame:
    """(bucket, keys, counts): n-grams that tasks have counted, sorted, a row for each bucket and HELD_GRAMS n-grams or task."""

    def sent(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate(held)
        held.clear()
        hashes.sort()
        begins = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        found, counts = hashes[begins], np.diff(begins, append=len(hashes))
        del hashes, begins
        bucket = bucket_of(found, buckets)
        ends = np.concatenate([np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
        keys = key_of(found).view(np.uint8).reshape(-1, 8)[:, :KEY]
        begins = np.concatenate([[0], ends[:-1]])
        for i in range(0, len(ends), 1024):
            some = list(zip(begins[i : i + 1024], ends[i : i + 1024], strict=True))
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array([int(bucket[a]) for a, _ in some], pa.int64()),
                    "keys": pa.array([keys[a:b].tobytes() for a, b in some], pa.binary()),
                    "counts": pa.array([counts[a:b].tobytes() for a, b in some], pa.binary()),
                }
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in sliced(batch, text_col, TEXT_BYTES):
                for hashes, _ in grams(*sequences(tokenise(part.column(text_col)))[:2], order):
                    held.append(hashes)
                    n += len(hashes)
                if n >= HELD_GRAMS:
                    yield from sent(held)
                    held, n = [], 0
        if n:
            yield from sent(held)
        release()

    return texts.select(F.col(f"`{text_col}`")).mapInArrow(run, "bucket long, keys binary, counts binary")


def build_segments(counted: DataFrame) -> DataFrame:
    """(bucket, size in lines, bits) from the rows of count_grams()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket"):
            rows = table.column("bucket").to_numpy()
            ends = [*(np.flatnonzero(rows[1:] != rows[:-1]) + 1).tolist(), len(rows)]
            for begin, end in zip([0, *ends[:-1]], ends, strict=True):
                # a bucket at a time, whose n-grams are bounded
                bucket, sent, times = int(rows[begin]), *(table.column(c).slice(begin, end - begin).to_pylist() for c in ("keys", "counts"))
                raw = np.frombuffer(b"".join(sent), np.uint8).reshape(-1, KEY)
                keys = np.zeros((len(raw), 8), np.uint8)
                keys[:, :KEY] = raw
                found, place = np.unique(keys.view(U).ravel(), return_inverse=True)
                counts = np.zeros(len(found), np.int64)
                np.add.at(counts, place, np.frombuffer(b"".join(times), np.int64))
                size, bits = segment(found, counts, bucket)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "size": pa.array([size], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    dealt = counted.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "bucket long, size long, bits binary")


def fit(texts: DataFrame, text_col: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> Model:
    """Counts the words and n-grams of all rows, and builds the filter as a table."""
    vocabulary = written(count_words(texts, text_col), "words")
    n, v = vocabulary.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    hot = {r["word"]: r["count"] for r in vocabulary.where((F.col("count") * HOT >= n) | (F.col("word") == END)).collect()}
    buckets = -(-max(n, 1) // BUCKET_TOKENS)
    segments = written(build_segments(count_grams(texts, text_col, order, buckets)), "filter")
    largest = segments.agg(F.coalesce(F.max("size"), F.lit(1))).first()[0] * LINE // 8
    per_block = max(1, block_bytes // largest)
    return Model(order, n, v, vocabulary, hot, segments, buckets, per_block, -(-buckets // per_block))


def load_block(model: Model, k: int) -> Block:
    """The k-th block on the driver: block_bytes at most, or a single segment."""
    first = k * model.per_block
    n = min(model.per_block, model.buckets - first)
    begins, sizes, held, at = np.zeros(n, np.int64), np.zeros(n, np.int64), [], 0
    for r in model.segments.where(F.col("bucket").between(first, first + n - 1)).toLocalIterator():
        begins[r["bucket"] - first], sizes[r["bucket"] - first] = at, r["size"]
        held.append(np.frombuffer(r["bits"], np.uint8))
        at += r["size"] * LINE // 8
    return Block(first, begins, sizes, np.concatenate([*held, np.zeros(1, np.uint8)]))


def _fill(part: pa.RecordBatch, text_col: str, block: Block, order: int, buckets: int) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """Levels that the block knows: a row for each position of the sequences, which lie between the offsets that come
    along, and a column for each order."""
    tokens = tokenise(part.column(text_col))
    seq, offsets, distinct, place = sequences(tokens)
    out = np.zeros((len(seq), order), np.uint8)
    # words are looked up once a slice
    out[:, 0] = probe(mixed(distinct + U(1)), block, buckets)[place]
    for n, (hashes, at) in enumerate(grams(seq, offsets, order)[1:], 1):
        out[at, n] = probe(hashes, block, buckets)
    return tokens, offsets, out


def _exact(tokens: Tokens, hot: tuple[pa.Array, np.ndarray], total: float, cold_type: pa.DataType) -> tuple:
    """Of each row: tokens, those known and the sum of logarithms over hot ones; the cold words with their number."""
    words, counts = hot
    found = np.asarray(pc.fill_null(pc.index_in(tokens.spelled, value_set=words), -1)).astype(np.int64)
    count = np.where(found >= 0, counts[found], 0) if len(found) else np.zeros(1, np.int64)
    codes, owner, rows = tokens.codes, tokens.owner, tokens.rows
    is_hot = count[codes] > 0
    end = int(counts[words.index(END).as_py()]) if words.index(END).as_py() >= 0 else 0
    n = np.bincount(owner, minlength=rows) + 1
    known = np.bincount(owner[is_hot], minlength=rows) + (end > 0)
    base = np.bincount(owner[is_hot], np.log10((count + ADD) / total)[codes[is_hot]], rows) + np.log10((end + ADD) / total)
    pair, times = np.unique(owner[~is_hot] * max(1, len(tokens.spelled)) + codes[~is_hot], return_counts=True)
    words = tokens.spelled.take(pa.array(pair % max(1, len(tokens.spelled))))
    begins = np.concatenate([[0], np.cumsum(np.bincount(pair // max(1, len(tokens.spelled)), minlength=rows))])
    cold = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.StructArray.from_arrays([words, pa.array(times, pa.int64())], ["word", "n"])).cast(cold_type)
    return n, known, base, cold


_COLD = T.ArrayType(T.StructType().add("word", "string").add("n", "long"))


def measure(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """A table with the `carry` columns of docs (default: all) and, for score(): lm_row (unique), lm_tokens, lm_known,
    lm_base, lm_cold and lm_levels, which holds the levels of all n-grams of the row. One pass over the texts for each
    block of the filter; of several passes each writes the texts once more."""
    from pyspark.sql.pandas.types import to_arrow_type

    names = [c for c in (docs.columns if carry is None else carry) if c != "lm_row"]
    spark, order, buckets = docs.sparkSession, model.order, model.buckets
    hot = spark.sparkContext.broadcast((pa.array(list(model.hot), pa.string()), np.array([*model.hot.values(), 0], np.int64)))
    cold_type = to_arrow_type(_COLD)
    total = model.n_tokens + ADD * (model.n_types + 1)
    keys = dict.fromkeys([*names, text_col])
    state = docs.select(*[F.col(f"`{c}`") for c in keys], F.monotonically_increasing_id().alias("lm_row"))
    first = T.StructType().add("lm_tokens", "long").add("lm_known", "long").add("lm_base", "double").add("lm_cold", _COLD).add("lm_levels", "binary")
    later = T.StructType().add("lm_levels", "binary")
    exact = ["lm_tokens", "lm_known", "lm_base", "lm_cold"]
    previous: Scratch | None = None
    for k in range(model.blocks):
        block = spark.sparkContext.broadcast(load_block(model, k))
        last = k == model.blocks - 1

        def make(k=k, block=block):
            release()

            def step(part: pa.RecordBatch):
                tokens, offsets, levels = _fill(part, text_col, block.value, order, buckets)
                mine = [levels[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                if not k:
                    return *_exact(tokens, hot.value, total, cold_type), mine
                # an n-gram is in one block alone
                return ([np.maximum(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)).tobytes() for a, b in zip(mine, part.column("lm_levels").to_pylist(), strict=True)],)

            return step

        kept = (names if last else list(keys)) + ["lm_row"] + (exact if k else [])
        found = arrow_map(state, text_col, later if k else first, make, kept, TEXT_BYTES, ("lm_levels",) if k else ())
        done = previous
        if last:
            state = written(found, "levels")
        else:
            previous = Scratch(spark)
            state = previous.written(found, "levels")
        if done:
            done.__exit__()
        block.unpersist()
    return state


def _joined(part: pa.RecordBatch, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The levels of all rows one below the other, and where each begins."""
    rows = part.column("lm_levels").to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, order), np.cumsum([0, *(len(r) // order for r in rows)])


def _contexts(levels: np.ndarray, begins: np.ndarray, order: int) -> np.ndarray:
    """For each token (every position but the first of a row) its level, then for n of 2 to `order` the least level of
    n-gram, history and the n-gram's last n-1 tokens, and the level of the history, 0 where the row has no such history."""
    inside = np.ones(len(levels), bool)
    inside[begins[:-1]] = False
    at = np.flatnonzero(inside)
    depth = at - np.repeat(begins[:-1], np.maximum(np.diff(begins) - 1, 0))  # tokens before, with the start
    out = np.zeros((len(at), 2 * order - 1), np.uint8)
    out[:, 0] = levels[at, 0]
    for n in range(2, order + 1):
        some = np.flatnonzero(depth >= n - 1)
        first = at[some] - n + 1
        out[some, 2 * n - 2] = levels[first, n - 2]
        out[some, 2 * n - 3] = np.minimum(np.minimum(levels[first, n - 1], levels[first, n - 2]), levels[first + 1, n - 2])
    return out


def _probability(contexts: np.ndarray, masses: list[float], n_tokens: int, n_types: int, left_out: int = 0) -> np.ndarray:
    """Of each token, up to the order that `masses` reach. With left_out 1 the token's own occurrence isn't counted."""
    p = (np.maximum(ESTIMATE[contexts[:, 0]] - left_out, 0) + ADD) / (n_tokens - left_out + ADD * (n_types + 1))
    for k, mass in enumerate(masses):
        gram, history = ESTIMATE[contexts[:, 2 * k + 1]], ESTIMATE[contexts[:, 2 * k + 2]]
        p = np.where(history > 0, (np.maximum(gram - left_out, 0) + mass * p) / (np.maximum(history - left_out, 0) + mass), p)
    return p


def fit_masses(measured: DataFrame, model: Model) -> list[float]:
    """m_2 ... m_order, from measured training texts: for each order the mass of the grid under which all tokens, each left
    out of the counts, are likeliest, given the masses of lower orders. Tokens with the same levels are weighed together."""
    masses: list[float] = []
    order, n_tokens, n_types = model.order, model.n_tokens, model.n_types
    for n in range(2, order + 1):
        below = list(masses)

        def run(batches: Iterator[pa.RecordBatch], n=n, below=below) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(MASSES))
            for batch in batches:
                for part in sliced(batch, "lm_levels", LEVEL_BYTES):
                    contexts = _contexts(*_joined(part, order), order)
                    packed = np.zeros(len(contexts), U)
                    for k in range(2 * n - 1):
                        packed = packed << U(7) | contexts[:, k].astype(U)
                    _, first, times = np.unique(packed, return_index=True, return_counts=True)
                    total += [(np.log(_probability(contexts[first], [*below, m], n_tokens, n_types, 1)) * times).sum() for m in MASSES]
            yield pa.RecordBatch.from_pydict({"mass": MASSES, "fit": total})

        found = measured.select("lm_levels").mapInArrow(run, "mass double, fit double").groupBy("mass").agg(F.sum("fit").alias("fit")).collect()
        masses.append(max(found, key=lambda r: (r["fit"], r["mass"]))["mass"] if found else MASSES[-1])
    return masses


def score(measured: DataFrame, model: Model, masses: list[float]) -> DataFrame:
    """The measured rows without what measure() added, with n_tokens, n_known (tokens that training texts hold),
    train_tokens, base_score and score: log10 of the text's add-ADD unigram probability by exact counts, and of its
    probability by the model."""
    order, n_tokens, n_types = model.order, model.n_tokens, model.n_types
    added = ["lm_row", "lm_tokens", "lm_known", "lm_base", "lm_cold", "lm_levels"]
    names = [c for c in measured.columns if c not in {*added, "score"}]

    def make():
        def step(part: pa.RecordBatch):
            levels, begins = _joined(part, order)
            logs = np.log10(_probability(_contexts(levels, begins, order), masses, n_tokens, n_types))
            return ([float(logs[a:b].sum()) for a, b in zip(begins[:-1] - np.arange(part.num_rows), begins[1:] - np.arange(1, part.num_rows + 1), strict=True)],)

        return step

    kept = measured.select(*[F.col(f"`{c}`") for c in names], *added[:4], "lm_levels")
    found = arrow_map(kept, "lm_levels", T.StructType().add("score", "double"), make, [*names, *added[:4]], LEVEL_BYTES)
    share = n_tokens + ADD * (n_types + 1)
    cold = measured.select("lm_row", F.explode("lm_cold").alias("c")).select("lm_row", "c.word", "c.n").join(model.vocabulary, "word", "left")
    cold = cold.withColumn("count", F.coalesce("count", F.lit(0)))
    cold = cold.groupBy("lm_row").agg(
        F.sum(F.when(F.col("count") > 0, F.col("n")).otherwise(0)).alias("lm_more"), F.sum(F.col("n") * F.log10((F.col("count") + F.lit(ADD)) / F.lit(share))).alias("lm_rest")
    )
    out = found.join(cold, "lm_row", "left")
    clash = {"n_tokens", "n_known", "train_tokens", "base_score", "score"}
    return out.select(
        *[F.col(f"`{c}`") for c in names if c not in clash],
        F.col("lm_tokens").alias("n_tokens"),
        (F.col("lm_known") + F.coalesce("lm_more", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("lm_base") + F.coalesce("lm_rest", F.lit(0.0))).alias("base_score"),
        "score",
    )


def score_texts(docs: DataFrame, model: Model, masses: list[float], text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """measure() and score() in one."""
    return score(measure(docs, model, text_col, carry), model, masses)
