import glob
import os

import duckdb
import numpy as np
import pytest

from metergrid.llm.hamming import BITS, CODE_BITS, SUBSTRINGS, Index, Model, nearest, substrings
from metergrid.llm.oracle import OP5_EXACT
from metergrid.llm.queries import op5_neighbours


def _duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("of", ["sf_dir", "larger_dir"])
def test_recall_against_exact_search(spark, request, of):
    sf_dir = request.getfixturevalue(of)
    exact = {(a, d): s for a, _, d, s in _duck(sf_dir).execute(OP5_EXACT).fetchall()}
    got = op5_neighbours(spark, sf_dir).collect()
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    assert len(found) == len(got) == len(exact)
    hit = found.keys() & exact.keys()
    assert len(hit) / len(exact) >= 0.9
    assert all(abs(found[k] - exact[k]) < 1e-9 for k in hit)


def test_edges(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.2).tolist()) for i in range(1, 60) if i != 50]
    rows[10] = (11, rows[9][1])  # a tie
    rows += [(50, base.tolist()), (0, None), (61, [0.0] * 16), (62, [float("nan")] * 16), (63, [1.0, None] * 8), (64, [1.0] * 8), (None, base.tolist()), (65, [float("inf")] * 16), (70, rows[3][1]), (70, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id AS id", "vec_id AS shard", "vec_id AS vec", "vec_id AS score")
    got = [tuple(r) for r in nearest(df, "vec_id", "embedding", lambda i: i % 50 == 0).orderBy("rank").collect()]
    good = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    asked = {i for i, _ in good if i % 50 == 0}
    assert {g[0] for g in got} == asked == {50} and [g[1] for g in got] == [1, 2, 3, 4, 5]
    q = next(v for i, v in good if i == 50)
    want = sorted((-float(v @ q / np.sqrt((v @ v) * (q @ q))), i) for i, v in good if i != 50)[:5]
    assert [g[2] for g in got] == [i for _, i in want] and np.allclose([g[3] for g in got], [-s for s, _ in want], atol=1e-12)


def test_fewer_candidates_than_asked_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in nearest(few, "vec_id", "embedding", lambda i: i % 50 == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert nearest(few.limit(0), "vec_id", "embedding", lambda i: i % 50 == 0).collect() == []
    assert nearest(few.where("vec_id = 0"), "vec_id", "embedding", lambda i: i % 50 == 0).collect() == []


def test_the_index_retrieves_every_code_within_the_radius_of_the_pigeonhole_and_not_all_rows():
    rng = np.random.default_rng(8)
    code = rng.integers(0, 256, size=(3000, CODE_BITS // 8), dtype=np.uint8)
    code[1:40] = code[0] ^ np.packbits(rng.random((39, CODE_BITS)) < 0.12, axis=1)
    parts, reach = substrings(code), 2
    share = []
    for q in range(5):
        retrieved = set()
        for j in range(SUBSTRINGS):
            index = Index(parts[:, j], code)
            mine = set(index.order[index.retrieve(parts[q, j], reach)].tolist())
            assert mine == {i for i in range(3000) if bin(int(parts[i, j] ^ parts[q, j])).count("1") <= reach}
            retrieved |= mine
        share.append(len(retrieved) / 3000)
        head = SUBSTRINGS * BITS // 8
        away = np.unpackbits(code[:, :head] ^ code[q, :head], axis=1).sum(axis=1)
        assert set(np.flatnonzero(away < SUBSTRINGS * (reach + 1)).tolist()) <= retrieved
    assert max(share) < 0.1


def test_radius_keeps_the_nearest_codes():
    rng = np.random.default_rng(9)
    code = rng.integers(0, 256, size=(500, CODE_BITS // 8), dtype=np.uint8)
    index = Index(substrings(code)[:, 0], code)
    found, many = index.within(int(substrings(code)[3, 0]), code[3], Model(np.eye(2), reach=BITS, radius=10, behind=4), 5)
    away = np.unpackbits(code ^ code[3], axis=1).sum(axis=1)
    assert many == 500 and set(found.tolist()) == set(np.flatnonzero(away <= np.sort(away)[4]).tolist())


def test_repeated_and_large_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(100, 400)] + [(50, [1e200, 2e200]), (7, [1e-200, 3e-200]), (50, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, "vec_id", "embedding", lambda i: i == 50).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 50), (2, 100), (3, 101), (4, 102), (5, 103)]
    assert len(got) == 5 and all(np.isfinite(r["score"]) for r in got)
    hundred = nearest(df, "vec_id", "embedding", lambda i: i % 50 == 0).where("query_id = 100").orderBy("rank").collect()
    assert [r["vec_id"] for r in hundred] == [50, 101, 102, 103, 104]
