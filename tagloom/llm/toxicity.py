"""Toxicity by weak supervision: lexicon and pattern voters, a label model, and a linear classifier."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import bounded_batches, by_value, fold, lean
from tagloom.llm.weak import ABSTAIN, LabelModel, fit_linear

# Insults of the seed lexicon.
INSULTS = frozenset(
    """
    idiot idiots moron morons stupid dumb scum trash garbage loser losers clown clowns pathetic worthless disgusting
    imbecile cretin bastard bitch jerk freak vermin filth filthy degenerate ugly fool coward parasite pig swine
    dumbass asshole shit crap bullshit fuck fucking whore slut retard retarded
    """.split()
)
PREFIXES = (4, 5, 6, 7, 8)
GROUPS = 8  # of mined patterns, by their first letters
LEAST_DOCS, LEAST_SHARE, LEAST_G, MOST_MINED = 5, 0.8, 22.0, 4096
LEAST_RATE = 0.004  # of the words of a text or window, for mined patterns to count
WINDOW = 500  # words that are looked at together
WORDS_KEPT = 100_000
PATTERNS_HELD = 200_000  # by a task, before it hands its counts on
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"\b[^\W\d_][*@#$]{1,4}[^\W\d_]+\b")
_ADDRESSED = re.compile(r"\b(?:you|du|vous|tu|usted)\b(?:'re| are| \w+)? ([^\W\d_]+)")


def word_patterns(word: str) -> list[str]:
    """The word itself and its beginnings, as mined patterns write them."""
    return [word + "$", *[word[:n] for n in PREFIXES if len(word) > n]]


def _partial_counts(
    frames: Iterator[pd.DataFrame], wanted: frozenset[str] | None, label: int
) -> Iterator[pd.DataFrame]:
    found: Counter[str] = Counter()

    def counted() -> pd.DataFrame:
        patterns = pd.Series(list(found), dtype=object)
        return pd.DataFrame({"pattern": patterns, "n": np.array(list(found.values()), dtype=np.int64)})

    for batch in frames:
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            if toxic == label:
                own = {p for w in set(_WORD.findall((text or "").lower())) for p in word_patterns(w)}
                found.update(own if wanted is None else own & wanted)
            if len(found) > PATTERNS_HELD:
                yield counted()
                found.clear()
    yield counted()


def mined_patterns(sample: DataFrame, positives: int, negatives: int) -> dict[str, float]:
    """Words and word beginnings that mark toxic rows of the sample, with their log ratio of document shares."""
    schema = "pattern string, n long"

    def count(wanted: frozenset[str] | None, label: int, least: int) -> dict[str, int]:
        part = sample.mapInPandas(lean(lambda frames: _partial_counts(frames, wanted, label)), schema)
        total = part.groupBy("pattern").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        return {r["pattern"]: r["n"] for r in total.collect()}  # bounded by the sample

    toxic = count(None, 1, LEAST_DOCS)
    clean = count(frozenset(toxic), 0, 1)
    share = positives / max(1, positives + negatives)
    scored = []
    for pattern, a in toxic.items():
        b = clean.get(pattern, 0)
        if (a + 0.5) / (a + b + 1) < LEAST_SHARE:
            continue
        g = 2 * (a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0.0))
        if g >= LEAST_G:  # likelihood ratio against chance
            ratio = math.log((a + 0.5) / (positives + 1)) - math.log((b + 0.5) / (negatives + 1))
            scored.append((-g, pattern, ratio))
    return {pattern: ratio for _, pattern, ratio in sorted(scored)[:MOST_MINED]}


class Evidence:
    """What a text shows: active features and the votes of all voters."""

    VOTERS = 7 + GROUPS

    def __init__(self, mined: dict[str, float]):
        self.ratio = list(mined.values())
        self.at = {pattern: i for i, pattern in enumerate(mined)}
        self.group = [zlib.crc32(p[:4].encode()) % GROUPS for p in mined]
        self.seeds = {word: len(mined) + i for i, word in enumerate(sorted(INSULTS))}
        self.width = len(mined) + len(self.seeds) + 2 * self.VOTERS
        self.words: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        found = self.words.get(word)
        if found is None:
            if len(self.words) > WORDS_KEPT:
                self.words.clear()
            found = tuple(self.at[p] for p in word_patterns(word) if p in self.at)
            if word in self.seeds:
                found += (self.seeds[word],)
            if len(word) <= 64:
                self.words[word] = found
        return found

    def _strongest(self, words: list[str]) -> list[int]:
        """Mined features of the window of WINDOW words with the greatest strength, of those with enough hits.

        Every window of the text is weighed, so what stands around a passage does not matter, nor how much of it.
        """
        found = [(i, own) for i, w in enumerate(words) if (own := [f for f in self._of(w) if f < len(self.ratio)])]
        at = np.array([i for i, _ in found])
        ends = np.searchsorted(at, at + WINDOW)  # a window begins at a hit
        n = ends - np.arange(len(at))
        enough = n >= LEAST_RATE * min(len(words), WINDOW)
        if not enough.any():
            return []
        best = np.zeros((GROUPS, len(at)))
        for i, (_, own) in enumerate(found):
            for f in own:
                best[self.group[f], i] = max(best[self.group[f], i], self.ratio[f])
        strength = np.zeros(len(at))
        width, table = 1, best  # maxima of ``width`` hits from each on
        while width <= n.max():
            now = np.flatnonzero((n >= width) & (n < 2 * width))
            strength[now] = np.maximum(table[:, now], table[:, ends[now] - width]).sum(axis=0)
            table = np.maximum(table[:, : max(0, table.shape[1] - width)], table[:, width:])
            width *= 2
        i = int(np.argmax(np.where(enough, strength, -1.0)))
        return sorted({f for _, own in found[i : ends[i]] for f in own})

    def __call__(self, text: str | None) -> tuple[np.ndarray, list[int]]:
        lowered = (text or "").lower()
        words = _WORD.findall(lowered)
        active = {f for word in set(words) for f in self._of(word)}
        mined = [f for f in active if f < len(self.ratio)]
        met = bool(mined)
        hits = sum(any(f < len(self.ratio) for f in self._of(w)) for w in words) if met else 0
        if hits < LEAST_RATE * len(words):  # a long text meets some pattern by chance: its strongest window speaks for it
            active.difference_update(mined)
            mined = self._strongest(words) if met else []
            active.update(mined)
        seeds = sum(w in INSULTS for w in words) if any(f >= len(self.ratio) for f in active) else 0
        groups = {self.group[f] for f in mined}
        # patterns that begin alike are one piece of evidence
        best: dict[int, float] = {}
        for f in mined:
            best[self.group[f]] = max(best.get(self.group[f], 0.0), self.ratio[f])
        strength = sum(best.values())
        aimed = seeds and any(m in INSULTS for m in _ADDRESSED.findall(lowered))
        votes = [
            1 if seeds else ABSTAIN,
            1 if seeds > 1 else ABSTAIN,
            1 if seeds >= max(1, 0.005 * len(words)) else ABSTAIN,
            1 if strength >= 2.5 else (ABSTAIN if met else 0),
            1 if _MASKED.search(lowered) else ABSTAIN,
            1 if aimed else ABSTAIN,
            ABSTAIN if active or met else 0,
            *[1 if g in groups else ABSTAIN for g in range(GROUPS)],
        ]
        first = len(self.ratio) + len(self.seeds)
        said = [first + 2 * j + v for j, v in enumerate(votes) if v != ABSTAIN]
        return np.array(sorted(active) + said, dtype=np.int64), votes


class ToxicityModel:
    def __init__(self, evidence: Evidence, coef: np.ndarray, bias: float, labels: LabelModel | None):
        self.evidence, self.coef, self.bias, self.labels = evidence, coef, bias, labels

    def score(self, text: str | None) -> float:
        active, _ = self.evidence(text)
        return float(1 / (1 + np.exp(-np.clip(self.coef[active].sum() + self.bias, -30, 30))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int, left_out: int, sample_rows: int) -> ToxicityModel:
    """Fit on about ``sample_rows`` labelled rows, chosen by hash, outside the left-out fold.

    The sample's labels pick the mined patterns and give the share of toxic rows. The label model then sees votes
    only, and the classifier only the label model's posteriors.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), folds) != left_out))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rate = min(1.0, sample_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate * 1_000_000)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = rows.join(F.broadcast(known), "doc_id").select("text", "toxic")  # about sample_rows ids
    counts = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    positives, negatives = counts.get(1, 0), counts.get(0, 0)
    evidence = Evidence(mined_patterns(sample, positives, negatives))

    def shown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [evidence(t) for t in batch["text"]]
            yield pd.DataFrame({"active": [a.tolist() for a, _ in both], "votes": [v for _, v in both]})

    seen = sample.mapInPandas(lean(shown), "active array<long>, votes array<int>").toPandas()  # numbers, no texts
    if not len(seen):
        coef = np.zeros(evidence.width)
        coef[len(evidence.ratio) : len(evidence.ratio) + len(evidence.seeds)] = 6.0
        return ToxicityModel(evidence, coef, -3.0, None)
    votes = np.array(seen["votes"].tolist())
    weight = np.ones(len(votes))
    model = LabelModel((positives + 1) / (positives + negatives + 2)).fit(votes, weight, fixed_prior=True)
    active = [np.asarray(a, dtype=np.int64) for a in seen["active"]]
    coef, bias = fit_linear(active, model.posterior(votes), weight, evidence.width)
    return ToxicityModel(evidence, coef, bias, model)


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 3,
    left_out: int = 1,
    threshold: float = 0.7,
    sample_rows: int = 20_000,
) -> DataFrame:
    """A toxicity score for every whole text: doc_id, held_out, score, predicted.

    ``docs`` needs doc_id and text, ``labels`` doc_id and toxic. Voters are a seed lexicon, groups of patterns mined
    from the labelled sample, and patterns of use; their accuracies and correlations are estimated from overlaps, and
    a linear classifier over the same evidence learns the posterior. A text whose mined
    patterns are rarer than LEAST_RATE counts by its strongest window of WINDOW words, wherever it stands; where no
    window meets that rate, the pattern voter abstains. Without labelled rows the seed lexicon decides.

    NULL and empty texts show no evidence and are scored for that; rows with a NULL id are scored and belong to
    the fold of an empty id; repeated rows are scored each; an empty table gives no rows.
    """
    model = fit_toxicity(docs, labels, folds, left_out, sample_rows)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = [model.score(t) for t in batch["text"]]
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "score": scores})
            out["predicted"] = (out["score"] >= threshold).astype("int32")
            yield out

    held = (fold(F.col("doc_id"), folds) == left_out).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text")
    return rows.mapInPandas(lean(score), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 3,
    left_out: int = 1,
    threshold: float = 0.7,
    sample_rows: int = 20_000,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below the threshold.

    The model and the score are those of ``toxicity_scores``: NULL and empty texts show no evidence and stay, rows with
    a NULL id and repeated rows are scored each, so equal texts stay or go together, texts of any length are scored as
    a whole, and an empty table gives no rows. The row travels as one struct, so columns of any name come back.
    """
    model = fit_toxicity(docs, labels, folds, left_out, sample_rows)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.struct_field(batch.column(0), "text").to_pylist()
            yield batch.filter(pa.array([model.score(t) < threshold for t in texts], pa.bool_()))

    rows = docs.select(F.struct("*").alias("row"))
    kept_rows = rows.mapInArrow(lean(keep), rows.schema)
    return kept_rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


by_value(__name__)
