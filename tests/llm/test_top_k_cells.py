"""The exact search deals blocks to cells: its rows are blocks, however many pairs of blocks there are."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def brute(rows, asks, k, scale=256):
    """The best of every row by whole numbers, held to the range of a long; of an id's rows the least vector asks."""
    width = max((len(v) for _, v in rows), default=1)
    ints = [(i, [int(np.floor(scale * x)) for x in v] + [0] * (width - len(v))) for i, v in rows]
    least = {}
    for i, v in rows:
        if asks(i):
            least[i] = min(least.get(i, v), v)
    out = []
    for q, v in least.items():
        own = [int(np.floor(scale * x)) for x in v] + [0] * (width - len(v))
        scores = [(sum(a * b for a, b in zip(own, c, strict=True)), i) for i, c in ints if i != q]
        held = sorted((-max(-(1 << 63), min((1 << 63) - 1, s)), i) for s, i in scores)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(held, 1)]
    return sorted(out)


def found(spark, rows, asks, k=5):
    from tagloom.llm.topk import top_k

    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(tuple(r) for r in top_k(frame, asks, k=k).collect())


def odd_rows(n, width, seed):
    """Lengths differ; equal vectors under many ids, and ids whose rows come twice or with another vector."""
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=width) * rng.choice([0.2, 1.0, 3.0])]) for i in range(n)]
    rows += [(n + i, list(rows[10][1])) for i in range(60)]
    return rows + rows[:20] + [(i, list(rows[i + 1][1])) for i in range(0, 40, 3)]


def test_pairs_of_blocks_are_no_rows(spark, monkeypatch):
    from tagloom.llm import topk

    seen = spark.sparkContext.accumulator(0)
    search = topk._search

    def counted(*args):
        run = search(*args)

        def each(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch

        return lambda batches: run(each(batches))

    monkeypatch.setattr(topk, "ROWS", 16)
    monkeypatch.setattr(topk, "_search", counted)
    rng = np.random.default_rng(4)
    data = rng.normal(size=(4800, 24))
    got = found(spark, [(i, [float(x) for x in v]) for i, v in enumerate(data)], F.col("vec_id") % 5 == 0)
    ints = np.floor(256 * data).astype(np.int64)
    scores = ints[::5] @ ints.T
    scores[np.arange(960), np.arange(0, 4800, 5)] = -(1 << 62)
    best = [(5 * q, n, int(c), int(s[c])) for q, s in enumerate(scores) for n, c in enumerate(np.lexsort((np.arange(4800), -s))[:5], 1)]
    assert got == best
    # 60 blocks of queries and 300 others, eight groups at least; their pairs are 18,000
    assert 300 <= seen.value <= 300 + 8 * 2 * 60


@pytest.mark.parametrize("held", [1, 24 * 64, 1 << 23])
def test_groups_of_queries_meet_all_groups(spark, monkeypatch, held):
    from tagloom.llm import topk

    monkeypatch.setattr(topk, "ROWS", 16)
    monkeypatch.setattr(topk, "HELD", held)
    rows = odd_rows(400, 24, 8)
    assert found(spark, rows, F.col("vec_id") % 3 == 0) == brute(rows, lambda i: i % 3 == 0, 5)


@pytest.mark.parametrize("rows_in_block", [1024, 8])
def test_all_equal_vectors_rank_by_id(spark, monkeypatch, rows_in_block):
    from tagloom.llm import topk

    monkeypatch.setattr(topk, "ROWS", rows_in_block)
    rows = [(i, [0.5, -0.25, 0.125]) for i in range(200)] + [(i, [0.0, 0.0, 0.0]) for i in range(200, 220)]
    assert found(spark, rows, F.col("vec_id") % 9 == 0, k=3) == brute(rows, lambda i: i % 9 == 0, 3)


@pytest.mark.parametrize("rows_in_block", [1024, 8])
def test_products_of_every_size(spark, monkeypatch, rows_in_block):
    from tagloom.llm import topk

    monkeypatch.setattr(topk, "ROWS", rows_in_block)
    rng = np.random.default_rng(9)
    sizes = [0.01, 1.0, 30.0, 3e3, 1e6, 1e10]
    rows = [(i, [float(x) for x in rng.normal(size=20) * sizes[i % 6]]) for i in range(150)]
    assert found(spark, rows, F.col("vec_id") % 4 == 0) == brute(rows, lambda i: i % 4 == 0, 5)
