"""Mixing, sharding, packing, toxicity, quality and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_text_operators import ROWS, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.01"


def sourced(spark, rows):
    schema = "doc_id long, text string, source string, size long, target double, slice int, shard int"
    return spark.createDataFrame([(d, t, s, 1, 1.0, 1, 1) for d, t, s in rows], schema)


def test_targets_equal_resharing(spark):
    from tagloom.llm.mixing import source_targets

    rng = random.Random(4)
    for trial in range(6):
        sizes = [(i == 11, f"s{i:02d}" if i < 11 else "", rng.choice([0, 3, 50, 900, 20_000])) for i in range(12)]
        got = source_targets(spark.createDataFrame(sizes, "missing boolean, name string, source_size long")).collect()
        got = {(r.missing, r.name): r.target for r in got}
        want = brute.waterfill([s for *_, s in sizes], [i % 3 + 1 for i in range(12)], 3)
        assert np.allclose([got[m, n] for m, n, _ in sizes], want), trial


def test_mix_meets_targets_and_repeats(spark):
    from tagloom.llm.mixing import mix

    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(40))), f"s{i % 4}") for i in range(400)]
    rows += [(400 + i, "a b c", None) for i in range(30)] + [(1, "x", "s1")] * 3 + [(None, None, None), (500, "", "empty")]
    docs = sourced(spark, rows)
    first = mix(docs)
    out = first.collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, mix(docs).collect()))
    assert len(out) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in out:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    for r in out:
        assert size[r.source] == r.source_size
    assert all(abs(taken[s] - target[s]) <= 20 for s in target)  # half a document
    assert mix(sourced(spark, [])).count() == 0
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_mix_prefers_quality(spark):
    from tagloom.llm.mixing import mix

    rows = [(i, ("%%% ### " * 20) if i % 2 else ("good words " * 20), "a") for i in range(4000)]
    rows += [(10_000 + i, "other words " * 20, "b") for i in range(1000)]
    got = mix(sourced(spark, rows), weights=(1, 30)).where("source = 'a'").collect()
    epoch = min(r.copies for r in got)
    good = sum(r.copies > epoch for r in got if r.doc_id % 2 == 0)
    assert good > 1.5 * sum(r.copies > epoch for r in got if r.doc_id % 2)


def test_mixed_rows_follow_the_copies(spark):
    from tagloom.llm.mixing import mix, mixed

    docs = table(spark, ROWS)
    want = Counter()
    for r in mix(docs).collect():
        want[r.doc_id] += r.copies
    out = mixed(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == +want


def test_longest_first_is_balanced_and_exact():
    from tagloom.llm.sharding import longest_first

    rng = random.Random(2)
    sizes = [(rng.randrange(1, 1000), (i,)) for i in range(500)]
    loads = [0] * 7
    placed = dict(longest_first(sizes, 7))
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        assert loads[placed[key]] == min(loads)
        loads[placed[key]] += size
    assert len(placed) == 500


def test_shards_keep_copies_together(spark):
    from tagloom.llm.sharding import shard_documents

    rng = random.Random(3)
    rows = [*ROWS, *((1000 + i, f"text {i} " * rng.randrange(1, 60)) for i in range(600))]
    rows += [(3000 + i, "copy of one") for i in range(50)]
    out = shard_documents(table(spark, rows), 16).collect()
    texts = dict(rows)
    slots, loads, place = defaultdict(list), Counter(), defaultdict(set)
    for r in out:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        assert (r.law, r.grown_shard) == ("bytes", None)
        if r.doc_id is not None:
            assert r.size == len((texts[r.doc_id] or "").encode()) + 1
            assert r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
            place[texts[r.doc_id]].add(r.shard)
    assert len(out) == len(rows) and all(len(s) == 1 for s in place.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) <= max(max(loads.values()) and sum(loads.values()) / 16 * 1.2, 50 * 12)
    assert shard_documents(table(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_every_piece_has_a_place_of_its_own(seed):
    from tagloom.llm.packing import pack_histogram

    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 2048])
    counts = Counter(min(capacity, int(rng.paretovariate(0.8)) + 1) for _ in range(rng.randrange(1, 3000)))
    used, seen = defaultdict(list), defaultdict(set)
    for size, rank, pieces, sequence, offset in pack_histogram(dict(counts), capacity):
        for i in range(pieces):
            used[sequence + i].append((offset, size))
            seen[size].add(rank + i)
    assert all(seen[s] == set(range(n)) for s, n in counts.items())
    for places in used.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= capacity
    assert sorted(used) == list(range(len(used)))
    total = sum(s * n for s, n in counts.items())
    assert len(used) <= max(11 / 9 * -(-total // capacity) + 2, sum(n for s, n in counts.items() if 2 * s > capacity) + 1)


def test_dominant_sets_do_not_cost_a_sequence():
    """Against the best packing by exhaustion, for small cases."""
    from functools import cache

    from tagloom.llm.packing import dominant_sets

    def best(items, capacity):
        @cache
        def fill(left):
            if not left:
                return 0
            first, rest, found = left[0], left[1:], len(left)
            for mask in range(1 << len(rest)):
                chosen = [rest[i] for i in range(len(rest)) if mask >> i & 1]
                if first + sum(chosen) <= capacity:
                    found = min(found, 1 + fill(tuple(rest[i] for i in range(len(rest)) if not mask >> i & 1)))
            return found

        return fill(tuple(items))

    rng = random.Random(9)
    for _ in range(60):
        items = sorted((rng.randrange(1, 11) for _ in range(rng.randrange(1, 9))), reverse=True)
        left = dict(Counter(items))
        fixed = sum(times for *_, times in dominant_sets(left, 10))
        rest = sorted((s for s, n in left.items() for _ in range(n)), reverse=True)
        assert fixed + best(rest, 10) == best(items, 10), items


def test_packed_ids_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    from tagloom.llm.packing import pack_documents

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs[:250]]
    rows += [(5000, "<|endoftext|> it's  two \n\n spaces\t x "), (5001, None), (5002, ""), (5003, "z" * 30_000)]
    rows += [(5004, "x<|endoftext|>y  <|endoftext|>\n<|endoftext|> z <|endoftext|>"), (5005, "<|endoftext|>" * 3)]
    file = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(file)
    for path, capacity in ((file, 2048), (file, 50), (RANKS, 2048)):
        whole.encode_special_tokens = path == RANKS  # a rank file has no special tokens
        ids = {d: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for d, t in rows}
        assert (50256 in ids[5004]) == (path == file)
        out = pack_documents(table(spark, rows), path, public_tokenizers.PATTERN, capacity).collect()
        pieces, used = defaultdict(list), defaultdict(list)
        for r in out:
            own = ids[r.doc_id][r.start : r.start + r.length]
            assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32
            pieces[r.doc_id].append((r.piece, r.start, r.length))
            used[r.sequence_id].append((r.offset, r.length))
        for d, own in pieces.items():
            own.sort()
            assert [p for p, *_ in own] == list(range(len(own)))
            assert sum(n for *_, n in own) == len(ids[d])
            assert all(n == capacity for *_, n in own[1:]) and (len(own) == 1) == (len(ids[d]) <= capacity)
        for places in used.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity
    assert pack_documents(table(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_label_model_ranks_voters():
    from tagloom.llm.weak import ABSTAIN, LabelModel

    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    right = [0.95, 0.9, 0.85, 0.8, 0.75, 0.65]
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth).astype(int) for p in right], axis=1)
    votes = np.concatenate([votes, votes[:, 3:4]], axis=1)  # a copy of the fourth voter
    votes[rng.random(votes.shape) < 0.2] = ABSTAIN
    weight = np.ones(4000)
    model = LabelModel(0.3).fit(votes, weight, fixed_prior=True)
    assert np.allclose(model.accuracies(), [*right, 0.8], atol=0.03)
    assert model.correlations[3, 6] > 0.5 and abs(model.correlations[0, 2]) < 0.1
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.9


def test_toxicity_on_the_held_out_fold(spark):
    from tagloom.llm.queries import op2_toxicity

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = op2_toxicity(spark, SF).collect()
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (brute.fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in out)
    assert all(r.predicted == (r.score >= 0.7) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in labels]
    caught = [r for r in held if r.predicted]
    assert sum(labels[r.doc_id] for r in caught) >= 0.8 * len(caught)
    assert len(caught) >= 0.6 * sum(labels[r.doc_id] for r in held)


def test_toxicity_learns_nothing_from_the_left_out_fold(spark):
    from tagloom.llm.toxicity import toxicity_scores

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn(
        "toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    a = {r.doc_id: r.score for r in toxicity_scores(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity_scores(docs, turned).collect()}
    assert a == b


def test_toxicity_edges(spark):
    from tagloom.llm.toxicity import toxicity_scores, without_toxic

    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = table(spark, [*ROWS, (900, "You are a stupid idiot, you worthless moron!")])
    out = {r.doc_id: r for r in toxicity_scores(docs, none).collect()}
    assert out[900].predicted == 1 and out[5].predicted == 0 and out[4].predicted == 0
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 7), (900, 1), (900, 1)], "doc_id long, toxic int")
    assert toxicity_scores(docs, odd).count() == len(ROWS) + 1
    assert toxicity_scores(table(spark, []), none).count() == 0
    kept = without_toxic(docs, none)
    assert kept.columns == docs.columns and kept.where("doc_id = 900").count() == 0 and kept.count() == len(ROWS)


def test_quality_against_labels(spark):
    from tagloom.llm.quality import quality_scores

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = quality_scores(docs).collect()
    assert len(out) == docs.count()
    good = [r.keep for r in out if labels.get(r.doc_id) == 1]
    low = [r.keep for r in out if labels.get(r.doc_id) == 0]
    assert np.mean(good) >= 0.97 and np.mean(low) <= 0.15
    assert quality_scores(table(spark, [])).count() == 0
    assert quality_scores(table(spark, ROWS)).count() == len(ROWS)


def test_one_of_each_class_stays(spark):
    from tagloom.llm.simhash import one_of_each

    docs = table(spark, ROWS)
    out = one_of_each(docs, 5, 6)
    assert out.columns == docs.columns
    classes = brute.simhash_classes(ROWS, 5, 6)
    named = {c for _, _, c in classes if c is not None}
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(named)
    assert one_of_each(table(spark, [])).count() == 0


def test_texts_without_repeats(spark):
    from tagloom.llm.suffix import without_repeats

    rows = [(d, t) for d, t in ROWS if d is not None]
    docs = table(spark, rows)
    out = without_repeats(docs, 100, keep_first=False)
    assert out.columns == docs.columns
    want = Counter()
    for (d, n, removed, _, kept), times in brute.without_repeats(rows, 100).items():
        if not removed or kept.decode("utf-8", "ignore"):
            want[d, kept.decode("utf-8", "ignore")] += times
    assert Counter((r.doc_id, r.text or "") for r in out.collect()) == want


def test_pipeline_stages_in_turn(spark):
    from test_copies import shingles
    from test_repeated_words import brute_words

    import corpus_pipeline
    from tagloom.llm.common import stored
    from tagloom.llm.queries import op2_toxicity

    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_copies", "repeated_strings", "source_mix", "packing",
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns, seen = docs, docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, before, SF))
        assert docs.columns == columns
        seen.append((before, docs))
        before = docs
    toxic, single, cut, mixed = (after for _, after in seen)
    scores = {r.doc_id: r.predicted for r in op2_toxicity(spark, SF).collect()}
    assert {r.doc_id for r in toxic.collect()} == {d for d, predicted in scores.items() if not predicted}
    # One document of each class of texts that are linked by a Jaccard similarity of 0.8.
    rows = [(r.doc_id, r.text) for r in toxic.collect()]
    sets = {t: shingles(t) for _, t in rows}
    order = sorted(set(sets.values()), key=sorted)
    at = {s: i for i, s in enumerate(order)}
    by_shingle = defaultdict(list)
    for i, own in enumerate(order):
        for shingle in own:
            by_shingle[shingle].append(i)
    shared = Counter((i, j) for own in by_shingle.values() for n, i in enumerate(own) for j in own[n + 1 :])
    near = {p for p, n in shared.items() if n >= 0.8 * (len(order[p[0]]) + len(order[p[1]]) - n)}
    root = list(range(len(order)))
    for _ in range(len(order)):
        before = list(root)
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    least = {}
    for d, t in rows:
        least[root[at[sets[t]]]] = min(d, least.get(root[at[sets[t]]], d))
    assert sorted(r.doc_id for r in single.collect()) == sorted(least.values()) and len(near) > 3
    rows = [(r.doc_id, r.text) for r in single.collect()]
    want = {d: t for d, t in brute_words(rows, 400, 50) if t}
    assert {r.doc_id: b"".join(r.text.encode().split()) for r in cut.collect()} == want
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    packed = corpus_pipeline.run(spark, SF)
    assert sum(r.n for r in packed.groupBy("doc_id", "start").agg(F.count("*").alias("n")).collect()) == packed.count()
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_pipeline_over_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mix_query_equals_its_sql(spark):
    from compare import connect, difference

    from tagloom.llm.queries import ORACLES, QUERIES

    con = connect(SF)
    assert difference(QUERIES["op4_source_mix"](spark, SF), con, ORACLES["op4_source_mix"]) is None
