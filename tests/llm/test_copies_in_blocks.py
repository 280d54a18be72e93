"""Units of a band that meet block by block, against brute force and by the number of pairs that become rows."""

import random

import numpy as np
from test_copies import jaccard, shingles, test_near_copies_equal_brute_force
from test_text_operators import table


def test_small_blocks_keep_all_links(spark, monkeypatch):
    from tagloom.llm import copies

    monkeypatch.setattr(copies, "BLOCK", 2)
    monkeypatch.setattr(copies, "MASS", 300)
    monkeypatch.setattr(copies, "COLUMNS", 16)
    test_near_copies_equal_brute_force(spark)


def test_shared_shingles_are_counted_by_columns(monkeypatch):
    from tagloom.llm import copies

    monkeypatch.setattr(copies, "COLUMNS", 7)
    rng = random.Random(1)
    sets = [np.array(sorted(rng.sample(range(60), rng.randrange(40))), dtype=np.int64) for _ in range(9)]
    got = copies._shared(sets, np.array([0, 3, 4]), np.array([1, 3, 8]))
    assert got.tolist() == [[0.0 + (len(set(sets[a]) & set(sets[b])) if a != b else got[1][1]) for b in (1, 3, 8)] for a in (0, 3, 4)]
    assert copies._shared([sets[0][:0], sets[0][:0]], np.array([0]), np.array([1])).tolist() == [[0.0]]


def test_many_texts_that_share_bands_are_no_rows_for_each_pair(spark, monkeypatch):
    """Texts at 0.76 of each other: nearly all pairs share a band, none is a link but the planted ones."""
    from tagloom.llm import copies

    common = [f"c{i}" for i in range(220)]
    rows = [(i, " ".join([*common, *(f"own{i}_{j}" for j in range(34))])) for i in range(90)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 90, 9)]
    assert 0.7 < jaccard(shingles(rows[0][1]), shingles(rows[1][1])) < 0.8
    tried, similar = [], copies._similar_pairs

    def counted(pairs, *args):
        tried.append(pairs.where("a != b").distinct().count())
        return similar(pairs, *args)

    monkeypatch.setattr(copies, "_similar_pairs", counted)
    out = copies.without_near_copies(table(spark, rows))
    assert sorted(r.doc_id for r in out.collect()) == list(range(90))
    assert max(tried) < len(rows) ** 2 / 5
