"""Exact and approximate searches against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int, vector string, rank int, score long"


def vectors(spark, rows):
    """Rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, v, 0, "x", 1, 5) for i, v in rows], SCHEMA)


def some_rows(n=140, width=24, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=width) * rng.choice([0.2, 1.0, 3.0])]) for i in range(n)]
    same = rows[10][1]
    rows += [(n + i, list(same)) for i in range(40)]  # equal vectors: ties by id
    rows += [(500, None), (501, [None] * width), (502, [math.nan] * width), (503, [math.inf] + [0.0] * (width - 1))]
    rows += [(504, [0.0] * width), (505, [1.0, 2.0]), (None, [1.0] * width)]
    return rows


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def padded(v, width):
    return np.array(v + [0.0] * (width - len(v)))


@pytest.mark.parametrize("rows_in_block", [1024, 16])
def test_top_k_equals_all_products(spark, monkeypatch, rows_in_block):
    from tagloom.llm import topk

    monkeypatch.setattr(topk, "ROWS", rows_in_block)
    rows = some_rows()
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 7 == 0, k=5).collect()
    ints = {i: np.floor(256 * padded(v, 24)).astype(np.int64) for i, v in rows if i is not None and usable(v)}
    want = set()
    for q in (i for i in ints if i % 7 == 0):
        best = sorted((-int(ints[q] @ ints[c]), c) for c in ints if c != q)[:5]
        want |= {(q, n, c, -s) for n, (s, c) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_k_of_few_and_of_very_large_numbers(spark):
    from tagloom.llm.topk import top_k

    rows = [(0, [1e12, 1.0]), (1, [1e12, -1.0]), (7, [3.0, 4.0])]
    got = {tuple(r) for r in top_k(vectors(spark, rows), F.col("vec_id") == 0).collect()}
    a, b = (256 * 10**12, 256), (256 * 10**12, -256)
    big = min((1 << 63) - 1, a[0] * b[0] + a[1] * b[1])
    assert got == {(0, 1, 1, big), (0, 2, 7, a[0] * 768 + a[1] * 1024)}


def test_searches_of_empty_tables(spark):
    from tagloom.llm.neighbours import nearest
    from tagloom.llm.topk import top_k

    for rows in ([], [(0, None)], [(0, [1.0, 2.0])]):
        assert top_k(vectors(spark, rows), F.col("vec_id") % 2 == 0).count() == 0
        assert nearest(vectors(spark, rows), F.col("vec_id") % 2 == 0).count() == 0


def test_exact_query_equals_its_sql(spark):
    from tagloom.llm.queries import ORACLES, QUERIES

    con = connect("/root/testdata/sf0.01")
    assert difference(QUERIES["op1_exact_top_k"](spark, "/root/testdata/sf0.01"), con, ORACLES["op1_exact_top_k"]) is None


def test_hadamard_is_orthonormal():
    from tagloom.llm.neighbours import hadamard

    h = hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)


def recall(got, rows, asks, k, width):
    data = {i: padded(v, width) for i, v in rows if i is not None and usable(v) and any(v)}
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    right = every = 0
    for q in (i for i in data if asks(i)):
        best = sorted((-float((data[q] * data[c]).sum()), c) for c in data if c != q)[:k]
        assert [s for _, s in found[q]] == sorted((s for _, s in found[q]), reverse=True)
        assert all(abs(s - float((data[q] * data[c]).sum())) < 1e-9 for c, s in found[q])
        assert len(found[q]) == len(best) and all(c != q for c, _ in found[q])
        right += len({c for c, _ in found[q]} & {c for _, c in best})
        every += len(best)
    return right / every


@pytest.mark.parametrize("k", [20, 5])
def test_nearest_finds_nearly_all(spark, monkeypatch, k):
    from tagloom.llm import neighbours

    monkeypatch.setattr(neighbours, "BLOCK", 32)
    rows = some_rows()
    got = neighbours.nearest(vectors(spark, rows), F.col("vec_id") % 5 == 0, k=k).collect()
    assert recall(got, rows, lambda i: i % 5 == 0, k, 24) >= 0.9


def test_nearest_query_recall(spark):
    from tagloom.llm.queries import op5_cross_polytope

    sf_dir = "/root/testdata/sf0.1"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert recall(op5_cross_polytope(spark, sf_dir).collect(), rows, lambda i: i % 20 == 0, 20, 64) >= 0.9
