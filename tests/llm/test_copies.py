"""Near copies against brute-force Jaccard."""

import random

import brute
from test_text_operators import ROWS, table


def shingles(text, words=5):
    parts = brute.lower(text).split()
    return frozenset(b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))) if parts else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited_rows():
    """Texts with word changes that put pairs at 0.6 to 1."""
    rng = random.Random(11)
    rows = []
    for base in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([40, 150, 400]))]
        rows.append((base * 10, " ".join(words)))
        for i in range(1, 4):
            changed = list(words)
            for at in rng.sample(range(len(words)), max(1, round(len(words) * rng.uniform(0.002, 0.04)))):
                changed[at] = f"n{base}_{i}_{at}"
            rows.append((base * 10 + i, " ".join(changed)))
    return rows


def test_near_copies_equal_brute_force(spark):
    import corpus_pipeline

    rows = edited_rows() + [(1000 + d, t) for d, t in ROWS if d is not None]
    sets = {t: shingles(t) for _, t in rows}
    order = sorted(set(sets.values()), key=lambda s: sorted(s))
    at = {s: i for i, s in enumerate(order)}
    group = brute.classes(range(len(order)), lambda a, b: jaccard(order[a], order[b]) >= 0.8)
    least = {}
    for d, t in rows:
        root = group[at[sets[t]]]
        least[root] = min(d, least.get(root, d))
    out = corpus_pipeline.near_copies(spark, table(spark, rows), "")
    assert out.columns == table(spark, rows).columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(least.values())
    assert corpus_pipeline.near_copies(spark, table(spark, []), "").count() == 0
