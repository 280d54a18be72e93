"""Document quality: overlapping heuristic labellers, expectation-maximisation, and a hashed linear scorer."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import bounded_batches, by_value, lean, stored
from tagloom.llm.weak import ABSTAIN, LabelModel, fit_linear

WIDTH = 1 << 12
SHAPES_KEPT = 100_000
_SYMBOLS = b"%$#&*|<>{}[]=_~^@+\\/"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_RUN = re.compile(r"(.)\1+")

# Statistic, then its bounds: a vote for low quality above the first, no doubt below the second.
ABOVE = (
    ("symbols", 0.08, 0.02),
    ("capitals", 0.5, 0.15),
    ("word_length", 14.0, 9.0),
    ("top_word", 0.3, 0.15),
    ("bars", 0.1, 0.01),
    ("exclamations", 0.2, 0.05),
    ("same_lines", 0.4, 0.1),
    ("sameness", 0.75, 0.6),
    ("no_stops", 0.99, 0.95),
)


def statistics(text: str | None) -> dict[str, float]:
    """Shares that the labellers look at; all are low in running prose."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), max(1, len(data))
    without = lambda marks: size - len(data.translate(None, marks)) if data else 0
    lines = [x for x in data.split(b"\n") if x.strip()]
    stops = data.count(b".") + data.count(b"?") + data.count(b"!")
    common = Counter(words).most_common(1)[0][1] if words else 0
    return {
        "words": float(n),
        "symbols": without(_SYMBOLS) / size,
        "capitals": without(_UPPER) / size,
        "digits": without(_DIGITS) / size,
        "word_length": sum(map(len, words)) / n if n else 0.0,
        "top_word": common / n if n >= 20 else 0.0,
        "bars": data.count(b"|") / n if n else 0.0,
        "exclamations": data.count(b"!") / n if n else 0.0,
        "same_lines": 1 - len(set(lines)) / len(lines) if len(lines) >= 4 else 0.0,
        "sameness": 1 - len(set(words)) / n if n >= 50 else 0.0,
        "no_stops": 1 - min(1.0, stops / n) if n >= 30 else 0.0,
    }


MARKS = ("symbols", "capitals", "bars", "exclamations")
VARIETY = ("top_word", "same_lines", "sameness")


def votes_of(stats: dict[str, float]) -> list[int]:
    """1 good, 0 low, ABSTAIN. Each defect has a labeller that only votes low, and one looks for texts without words.

    Three labellers only vote good, and only if no defect was seen: for plain marks, for variety, and for both with
    ordinary words and sentence ends.
    """
    low = [0 if stats["words"] and stats[k] > bound else ABSTAIN for k, bound, _ in ABOVE]
    low.append(ABSTAIN if stats["words"] else 0)
    calm = {k for k, _, bound in ABOVE if stats[k] <= bound} if 0 not in low else set()
    good = [calm.issuperset(MARKS), calm.issuperset(VARIETY), len(calm) == len(ABOVE)]
    return low + [1 if g else ABSTAIN for g in good]


def _shape(word: str) -> str:
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word[:64])
    return _RUN.sub(r"\1", kinds)


class Hashed:
    """Active features of a text: shapes of its words and steps of its statistics, hashed to WIDTH places."""

    def __init__(self) -> None:
        self.shapes: dict[str, int] = {}

    def __call__(self, text: str | None, stats: dict[str, float]) -> np.ndarray:
        found = set()
        for word in set((text or "").split()):
            at = self.shapes.get(word)
            if at is None:
                at = zlib.crc32(b"shape " + _shape(word).encode("utf-8", "surrogatepass")) % WIDTH
                if len(self.shapes) > SHAPES_KEPT:
                    self.shapes.clear()
                if len(word) <= 64:
                    self.shapes[word] = at
            found.add(at)
        for name, value in stats.items():
            step = int(np.log2(value + 1)) if name in ("words", "word_length") else int(value * 20)
            found.add(zlib.crc32(f"{name} {step}".encode()) % WIDTH)
        return np.array(sorted(found), dtype=np.int64)


def quality_scores(docs: DataFrame, threshold: float = 0.5, sample_rows: int = 20_000) -> DataFrame:
    """A quality score for every whole text: doc_id, score (0 to 1), predicted (1 good), keep.

    ``docs`` needs doc_id and text. Labellers vote by simple statistics. All documents are counted by how they were
    voted on, which is a bounded table (three answers for each labeller), and expectation-maximisation estimates the
    labellers' accuracies from it. A linear scorer over hashed word shapes and steps of the statistics learns the
    posteriors of about ``sample_rows`` documents chosen by hash; no labels are used.

    NULL and empty texts are voted low; rows with a NULL id and repeated rows are scored each; an empty table gives
    no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rate = min(1.0, sample_rows / max(1, rows.count()))
    pick = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(1_000_000)) < rate * 1_000_000

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = Hashed()
        for batch in batches:
            stats = [statistics(t) for t in batch["text"]]
            votes = [votes_of(s) for s in stats]
            active = [
                hashed(t, s).tolist() if chosen else None
                for t, s, chosen in zip(batch["text"], stats, batch["pick"], strict=True)
            ]
            yield pd.DataFrame({"votes": votes, "active": active})

    voted = stored(rows.select("text", pick.alias("pick")).mapInPandas(lean(vote), "votes array<int>, active array<long>"))
    counts = voted.groupBy("votes").count().toPandas()  # at most 3 ** labellers rows
    sample = voted.where(F.col("active").isNotNull()).toPandas()
    if len(sample):
        model = LabelModel(0.85).fit(np.array(counts["votes"].tolist()), counts["count"].to_numpy(float))
        target = model.posterior(np.array(sample["votes"].tolist()))
        active = [np.asarray(a, dtype=np.int64) for a in sample["active"]]
        coef, bias = fit_linear(active, target, np.ones(len(target)), WIDTH)
    else:
        coef, bias = np.zeros(WIDTH), 0.0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = Hashed()
        for batch in batches:
            sums = np.array([coef[hashed(t, statistics(t))].sum() for t in batch["text"]]) + bias
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64")})
            out["score"] = 1 / (1 + np.exp(-np.clip(sums, -30, 30)))
            out["predicted"] = (out["score"] >= threshold).astype("int32")
            out["keep"] = out["score"] >= threshold
            yield out

    return rows.mapInPandas(lean(score), "doc_id long, score double, predicted int, keep boolean")


by_value(__name__)
