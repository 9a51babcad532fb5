"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors are rotated by learned rotations (iterative quantisation: the rotation that brings the signs closest
to the rotated vectors, from several starts) and reduced to signs, CODE_BITS bits in all. They aren't centred, so that
the angle between two vectors is the expected share of the bits in which they differ. The first SUBSTRINGS * BITS bits
are cut into substrings, each with an index of all rows by its value.

Search: two codes within Hamming distance r of each other differ in some substring by r // SUBSTRINGS bits at most
(pigeonhole). A query probes, in each index, the buckets within `reach` bits of its own value. Only the codes retrieved
are compared in full; those within the query's radius are reranked by the cosine of the vectors themselves. Reach and
radius are learnt on a sample, from the nearest neighbours there: the reach at which the index retrieves AIM of them, the
radius that holds 99 % of them, and how far they lie behind the k-th nearest code. Neighbours in all rows are nearer than
in the sample, so this errs to the safe side. Queries that retrieve fewer than k rows probe all buckets.

An index is dealt by (substring, leading bits of its value) into groups of about INDEX_ROWS entries of some 50 bytes; a
query goes to the groups within its reach only. Vectors travel once, to be reranked.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metergrid.llm.common import Scratch, bounded_sample, written

CODE_BITS, BITS, SUBSTRINGS = 320, 16, 12
#: Share of the sample's nearest neighbours that the index is to retrieve, and of those that the radius holds.
AIM, HELD = 0.93, 0.99
#: Rows that rotations, reach and radius are learnt from at most, and those of them that ask.
TRAIN_ROWS, TRAIN_QUERIES = 10_000, 400
#: Entries of an index group, vectors of a rerank group, candidates in a row between the two.
INDEX_ROWS, SHARD_ROWS, LIST = 1 << 18, 1 << 16, 1 << 10
ROUNDS, SEED = 30, 20240819
#: All values of a substring by the number of their bits, and how many have at most as many.
MASKS = np.argsort(np.bitwise_count(np.arange(1 << BITS, dtype=np.uint32)), kind="stable").astype(np.uint16)
WITHIN = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << BITS, dtype=np.uint32)), minlength=BITS + 1))


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) with vectors as arrays of double: ids and vectors that are there, finite and not zero, of the most
    frequent length (of the shorter one, where two are as frequent)."""
    vec = F.col("vec")
    good = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(
        F.col("id").isNotNull()
        & vec.isNotNull()
        & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(vec, lambda x: x != 0)
    )
    size = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("vec") == (size["n"] if size else -1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; very large and small components are scaled first."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codes(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """(rows x CODE_BITS / 8) bytes."""
    return np.packbits(unit(x) @ turn >= 0, axis=1)


def substrings(code: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(code[:, : SUBSTRINGS * BITS // 8]).view(">u2").astype(np.uint16)


def distances(code: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(code.view(np.uint64) ^ one.view(np.uint64)).sum(axis=-1, dtype=np.int64)


@dataclass
class Model:
    turn: np.ndarray
    reach: int = BITS
    radius: int = CODE_BITS
    #: how much farther than the k-th nearest code a near vector's code may be
    behind: int = CODE_BITS


def learn(good: DataFrame, k: int) -> Model:
    """Rotations, reach and radius from TRAIN_ROWS rows at most."""
    held = bounded_sample(good, "id", TRAIN_ROWS).limit(TRAIN_ROWS).collect()
    held.sort(key=lambda r: (r["id"], r["vec"]))
    x = unit(np.array([r["vec"] for r in held]))
    dims = x.shape[1]
    rng, parts = np.random.default_rng(SEED), []
    for _ in range(-(-CODE_BITS // dims)):
        turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(x.T @ np.where(x @ turn >= 0, 1.0, -1.0))
            turn = u @ v
        parts.append(turn)
    model = Model(np.concatenate(parts, axis=1)[:, :CODE_BITS])
    code = codes(x, model.turn)
    parts, need, far, behind = substrings(code), [], [], []
    for q in rng.permutation(len(x))[:TRAIN_QUERIES]:
        score = x @ x[q]
        score[q] = -2
        best = np.argsort(-score, kind="stable")[: min(k, len(x) - 1)]
        if not len(best):
            continue
        away = distances(code, code[q])
        need += list(np.bitwise_count(parts[best] ^ parts[q]).min(axis=1))
        far += list(away[best])
        away[q] = CODE_BITS
        behind += list(away[best] - np.partition(away, len(best) - 1)[len(best) - 1])
    if need:
        model.reach = int(np.ceil(np.quantile(need, AIM)))
        model.radius, model.behind = int(np.ceil(np.quantile(far, HELD))), int(max(0, np.ceil(np.quantile(behind, HELD))))
    return model


class Index:
    """The rows of one group by the values of a substring."""

    def __init__(self, part: np.ndarray, code: np.ndarray):
        order = np.argsort(part, kind="stable")
        self.order, self.code = order, code[order]
        self.cut = np.searchsorted(part[order], np.arange((1 << BITS) + 1))

    def retrieve(self, value: int, reach: int) -> np.ndarray:
        """Places in the order of values of the rows within reach of value."""
        probes = MASKS[: WITHIN[reach]] ^ np.uint16(value)
        start = self.cut[probes]
        many = self.cut[probes.astype(np.int64) + 1] - start
        full = np.flatnonzero(many)
        start, many = start[full], many[full]
        return np.repeat(start - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(full) else np.zeros(0, np.int64)

    def within(self, value: int, one: np.ndarray, model: Model, k: int) -> tuple[np.ndarray, int]:
        """Rows retrieved within the query's radius, and how many were retrieved. The k nearest codes always count."""
        places = self.retrieve(value, model.reach)
        if not len(places):
            return places, 0
        away = distances(self.code[places], one)
        last = int(np.partition(away, k - 1)[k - 1]) if len(away) > k else CODE_BITS
        return self.order[places[away <= max(last, min(model.radius, last + model.behind))]], len(places)


ENTRY = "g long, asks int, row long, id long, code binary, vec array<double>"


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def entries(rows: DataFrame, model, bits: int, asks: bool) -> DataFrame:
    """ENTRY rows of rows (row, id, vec): of a stored row one for each index; of a query one for each group of each
    index that has values within its reach, with its vector. A group is (substring, first `bits` bits)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = model.value
            code = codes(_vectors(batch.column("vec")), m.turn)
            lead = substrings(code).astype(np.int64) >> (BITS - bits)
            near = np.arange(1 << bits)
            near = near[np.bitwise_count(near) <= m.reach] if asks else near[:1]
            for j in range(SUBSTRINGS):
                at = np.repeat(np.arange(batch.num_rows), len(near))
                g = (j << BITS) + (np.tile(near, batch.num_rows) ^ lead[at, j])
                vec = batch.column("vec").take(pa.array(at)) if asks else pa.nulls(len(at), pa.list_(pa.float64()))
                taken = [batch.column(c).take(pa.array(at)) for c in ("row", "id")]
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.full(len(at), int(asks), np.int32)), *taken, pa.array([x.tobytes() for x in code[at]], pa.binary()), vec], names=["g", "asks", "row", "id", "code", "vec"])

    return rows.select("row", "id", "vec").mapInArrow(run, ENTRY)


def _by_group(batches, key: str):
    """(group, asks, part of a batch) of rows that come sorted by group and asks."""
    for batch in batches:
        if not batch.num_rows:
            continue
        g, asks = batch.column(key).to_numpy(), batch.column("asks").to_numpy()
        cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (asks[1:] != asks[:-1])) + 1), len(g)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(g[a]), bool(asks[a]), batch.slice(a, b - a)


def candidates(there: DataFrame, asked: DataFrame, model, bits: int, shards: int, k: int) -> DataFrame:
    """(shard, row, vec, found, retrieved): for each query the stored rows of a shard within its radius, by probing; lists
    of LIST rows at most. `row` names the query."""

    def run(batches):
        held, now, index, rows = [], None, None, None
        for g, asks, part in _by_group(batches, "g"):
            if g != now:
                held, now, index = [], g, None
            if not asks:
                held.append(part)
                continue
            if not held:
                continue
            m = model.value
            j = g >> BITS
            if index is None:
                code = np.concatenate([_bytes(x.column("code")) for x in held])
                rows = np.concatenate([x.column("row").to_numpy() for x in held])
                index = Index(substrings(code)[:, j], code)
            code = _bytes(part.column("code"))
            value = substrings(code)[:, j]
            shard, at, lists, many = [], [], [], []
            for i in range(part.num_rows):
                found, n = index.within(value[i], code[i], m, k)
                found = rows[found]
                where = found % shards
                for s in np.unique(where):
                    mine = found[where == s]
                    for a in range(0, len(mine), LIST):
                        shard.append(int(s))
                        at.append(i)
                        lists.append(mine[a : a + LIST])
                        many.append(n)
                        n = 0
            if at:
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), part.column("row").take(at), part.column("id").take(at), part.column("vec").take(at), pa.array(lists, pa.list_(pa.int64())), pa.array(many, pa.int64())], names=["shard", "row", "id", "vec", "found", "retrieved"])

    ordered = there.union(asked).repartition("g").sortWithinPartitions("g", "asks")
    return ordered.mapInArrow(run, "shard long, row long, id long, vec array<double>, found array<long>, retrieved long")


def reranked(lists: DataFrame, rows: DataFrame, shards: int, k: int) -> DataFrame:
    """(query, query_id, id, score): the k nearest of each query's candidates in a shard, by cosine."""
    stored = rows.select((F.col("row") % shards).alias("shard"), F.lit(0).alias("asks"), "row", "id", "vec", F.lit(None).cast("array<long>").alias("found"))
    asked = lists.select("shard", F.lit(1).alias("asks"), "row", "id", "vec", "found")

    def run(batches):
        held, now, x, keys, ids = [], None, None, None, None
        query, best = None, None

        def done():
            if query is None:
                return None
            row, qid, vec, found = query
            found = np.unique(np.concatenate(found))
            at = np.searchsorted(keys, found)
            own = np.flatnonzero((ids[at] == qid) & (x[at] == vec).all(axis=1))
            at = np.delete(at, own[:1])  # the query's own row
            score = (unit(x[at]) * unit(vec[None])).sum(axis=1) if len(at) else np.zeros(0)  # row by row: equal vectors tie
            pick = np.lexsort((ids[at], -score))[:k]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(pick), row)), pa.array(np.full(len(pick), qid)), pa.array(ids[at][pick]), pa.array(score[pick])], names=["query", "query_id", "id", "score"])

        for s, asks, part in _by_group(batches, "shard"):
            if s != now:
                if (best := done()) is not None:
                    yield best
                held, now, x, query = [], s, None, None
            if not asks:
                held.append(part)
                continue
            if x is None:
                x = np.concatenate([_vectors(p.column("vec")) for p in held])
                keys = np.concatenate([p.column("row").to_numpy() for p in held])
                ids = np.concatenate([p.column("id").to_numpy() for p in held])
                order = np.argsort(keys)
                x, keys, ids = x[order], keys[order], ids[order]
            q, vec = part.column("row").to_numpy(), _vectors(part.column("vec"))
            for i in range(part.num_rows):
                found = part.column("found")[i].values.to_numpy()
                if query is not None and query[0] == q[i]:
                    query[3].append(found)
                    continue
                if (best := done()) is not None:
                    yield best
                query = (q[i], part.column("id")[i].as_py(), vec[i], [found])
        if (best := done()) is not None:
            yield best

    ordered = stored.union(asked).repartition("shard").sortWithinPartitions("shard", "asks", "row")
    return ordered.mapInArrow(run, "query long, query_id long, id long, score double")


def nearest(rows: DataFrame, id_col: str, vec_col: str, is_query: Callable[[Column], Column], k: int = 5) -> DataFrame:
    """(query_id long, rank int, id_col long, score double): for each row that the column is_query marks, the k rows
    found with the largest cosines (double precision, on the original vectors), ties to smaller ids.

    Rows with null ids, and vectors that are null, zero, not finite or of another length than most, take no part.
    A query's own row is no candidate; of repeated ids, the row with the smallest vector asks. Of equal vectors, the k + 1
    smallest ids are indexed: no other can be among the k nearest of any query. Fewer than k candidates are all
    returned; without any there is no row.
    """
    spark = rows.sparkSession
    with Scratch(spark) as tmp:
        good = usable(rows, id_col, vec_col)
        copies = good.withColumn("copy", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("copy") <= k + 1)
        there = tmp.written(copies.select(F.xxhash64("vec", "copy").bitwiseAND(F.lit((1 << 62) - 1)).alias("row"), "id", "vec"), "rows")
        total = there.count()
        if total < 2:
            return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
        asked = tmp.written(good.where(is_query(F.col("id"))).groupBy("id").agg(F.min("vec").alias("vec")).select(F.col("id").alias("row"), "id", "vec"), "asked")
        model = learn(there, k)
        bits = min(BITS, max(0, (total // INDEX_ROWS).bit_length()))
        shards = -(-total // SHARD_ROWS)

        def search(asked: DataFrame, model: Model) -> DataFrame:
            held = spark.sparkContext.broadcast(model)
            lists = candidates(entries(there, held, bits, False), entries(asked, held, bits, True), held, bits, shards, k)
            return reranked(lists, there, shards, k)

        best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found = tmp.written(ranked(search(asked, model)), "found")
        enough = found.groupBy("query").count().where(F.col("count") >= min(k, total - 1)).select(F.col("query").alias("row"))
        short = tmp.written(asked.join(enough, "row", "left_anti"), "short")
        if short.limit(1).count():
            again = ranked(search(short, Model(model.turn)))
            found = found.join(short.select(F.col("row").alias("query")), "query", "left_anti").unionByName(again)
        return written(found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"), "nearest")
