"""Hard negatives against all products; the curve and the bounds by themselves."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int, block long, floor long, windows int, rank int"


def vectors(spark, rows):
    """Rows with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, v, lab, 1, 2, 3, 4) for i, lab, v in rows], SCHEMA)


def some_rows(n=260, width=12, seed=8):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in rng.normal(size=width) * rng.choice([0.3, 1.0])]) for i in range(n)]
    rows += [(n + i, i % 2, list(rows[20][2])) for i in range(60)]  # equal vectors: ties by id
    rows += [(20, 1, list(rows[20][2])), (40, 3, list(rows[41][2])), (41, rows[41][1], list(rows[41][2]))]  # ids that repeat
    rows += [(500, None, [1.0] * width), (501, 1, None), (502, 1, [None] * width), (503, 1, [math.nan] * width)]
    rows += [(None, 1, [1.0] * width), (520, 1, [math.inf] + [0.0] * (width - 1)), (540, 2, [1e308] * width)]
    return rows + [(560, 2, [0.0] * width), (580, 3, [1.0, 2.0])]


def expected(rows, asks, width, k=5, m=10):
    data = []
    for i, label, v in rows:
        if i is None or label is None or v is None or not all(x is not None and math.isfinite(256 * x) for x in v):
            continue
        data.append((i, label, [math.floor(256 * x) for x in v] + [0] * (width - len(v)), v))
    anchors = {}
    for i, label, ints, v in sorted(data, key=lambda d: (d[1], d[3])):
        if asks(i):
            anchors.setdefault(i, (label, ints))
    out = Counter()
    for a, (label, ints) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(ints, o, strict=True)), i, lab) for i, lab, o, _ in data if i != a]
        scored.sort()
        for p, i, _ in [s for s in scored if s[2] == label][:k]:
            fits = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:m]
            out.update((a, i, rank, s[1], -p, -s[0]) for rank, s in enumerate(fits, 1))
    return out


@pytest.mark.parametrize(("in_block", "page", "asking", "group"), [(512, 256, 512, 16), (16, 3, 4, 2)])
def test_hard_negatives_equal_all_products(spark, monkeypatch, in_block, page, asking, group):
    from tagloom.llm import negatives

    for name, value in (("ROWS", in_block), ("PAGE", page), ("ANCHORS", asking), ("SLICE", group)):
        monkeypatch.setattr(negatives, name, value)
    rows = some_rows()
    got = negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 20 == 0)
    want = expected(rows, lambda i: i % 20 == 0, 12)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 200


def test_few_rows_and_empty_tables(spark):
    from tagloom.llm.negatives import hard_negatives

    for rows in ([], [(0, 1, None)], [(0, 1, [1.0, 2.0])], [(0, 1, [1.0]), (1, 1, [2.0])], [(0, 1, []), (1, 2, [])]):
        assert hard_negatives(vectors(spark, rows), F.col("vec_id") == 0).count() == 0
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [2.0, 0.0]), (2, 2, [1.0, 9.0]), (3, 2, [1.9, 0.0]), (4, 1, [-1.0, 0.0])]
    got = hard_negatives(vectors(spark, rows), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 256 * 512, 256 * 256)]


@pytest.mark.parametrize(("axes", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_the_curve_goes_through_every_cell_by_single_steps(axes, bits):
    from tagloom.llm.negatives import hilbert_keys

    cells = np.array(np.meshgrid(*[range(1 << bits)] * axes)).reshape(axes, -1).T
    keys = hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(1 << axes * bits))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_are_met_at_corners():
    from tagloom.llm.negatives import bounds

    rng = np.random.default_rng(2)
    rows, anchors = rng.integers(-300, 300, (40, 6)).astype(float), rng.integers(-300, 300, (7, 6)).astype(float)
    low, high = rows.min(axis=0)[None], rows.max(axis=0)[None]
    least, most = bounds(anchors, low, high)
    products = anchors @ rows.T
    assert (least[:, 0] <= products.min(axis=1)).all() and (products.max(axis=1) <= most[:, 0]).all()
    corners = np.array(np.meshgrid(*zip(low[0], high[0], strict=True))).reshape(6, -1).T
    assert np.allclose((anchors @ corners.T).max(axis=1), most[:, 0])


def test_blocks_that_cannot_hold_a_hit_are_not_read(spark, monkeypatch):
    from tagloom.llm import negatives

    monkeypatch.setattr(negatives, "ROWS", 8)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 6)) * 10
    rows = [(i, i % 2, [float(x) for x in centres[i % 12] + rng.normal(size=6) * 0.05]) for i in range(240)]
    counted = []
    real = negatives._reads

    def reads(*args):
        out = real(*args).cache()
        counted.append((out.count(), args[1].collect()))
        return out

    monkeypatch.setattr(negatives, "_reads", reads)
    got = negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") == 0).collect()
    assert Counter(map(tuple, got)) == expected(rows, lambda i: i == 0, 6)
    blocks = sum(len(p["blocks"]) // 8 for p in counted[0][1])
    assert blocks >= 30 and counted[0][0] <= blocks // 3


def test_query_equals_its_sql(spark):
    from compare import connect, difference

    from tagloom.llm.queries import ORACLES, QUERIES

    con = connect("/root/testdata/sf0.01")
    name = "op11_hard_negatives"
    assert difference(QUERIES[name](spark, "/root/testdata/sf0.01"), con, ORACLES[name]) is None
