"""Near copies by exact Jaccard similarity of word shingles, over candidates from MinHash bands and SimHash masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import bounded_batches, by_value, give_back, lean, scope, stored
from tagloom.llm.graph import components
from tagloom.llm.simhash import first_of_each, fingerprints_of, links, shingle_hashes

BANDS, DEEP = 40, 8  # a pair of similarity s shares a band with probability 1 - (1 - s^8)^40: 0.9994 at 0.8
PART = 1 << 12  # shingles whose permutations are made at a time
BLOCK = 512  # units of a band that meet each other in one step
MASS = 1 << 17  # shingles of such units
COLUMNS = 1 << 12  # shingles that are counted at a time
_ODD = np.random.default_rng(42).integers(0, 1 << 32, BANDS * DEEP, dtype=np.uint32) | np.uint32(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text in order; none for a text without words."""
    chunks = [np.unique(np.array(c, dtype=np.uint64)) for c in shingle_hashes(text or "", words)]
    return np.unique(np.concatenate(chunks)) if chunks else np.zeros(0, np.uint64)


def band_keys(sets: list[np.ndarray]) -> list[list[int]]:
    """BANDS signed keys for each set, each of DEEP minima; an empty set has none."""
    least = np.full((len(sets), BANDS * DEEP), np.iinfo(np.uint32).max, dtype=np.uint32)
    parts: list[np.ndarray] = []
    owner: list[int] = []
    held = 0

    def take() -> None:
        starts = np.cumsum([0, *map(len, parts[:-1])])
        mixed = _ODD[:, None] * np.concatenate(parts)[None, :]
        np.minimum.at(least, owner, np.minimum.reduceat(mixed, starts, axis=1).T)
        parts.clear(), owner.clear()

    for i, own in enumerate(sets):
        short = (own >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), PART):
            parts.append(short[at : at + PART])
            owner.append(i)
            held += len(parts[-1])
            if held >= PART:
                take()
                held = 0
    if parts:
        take()
    out = []
    for own, row in zip(sets, least, strict=True):
        keys = [xxhash.xxh64_intdigest(row[b * DEEP : (b + 1) * DEEP].tobytes(), b) for b in range(BANDS)] if len(own) else []
        out.append(np.array(keys, dtype=np.uint64).view(np.int64).tolist())
    return out


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, text_hash, unit, size, print, bands``: texts with the same shingles are one unit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            sets = [shingle_set(t, words) for t in texts]
            units = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], dtype=np.uint64)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "text_hash": batch["text_hash"],
                    "unit": units.view(np.int64),
                    "size": np.array([len(s) for s in sets], dtype=np.int64),
                    "print": fingerprints_of(texts, words).view(np.int64),
                    "bands": band_keys(sets),
                }
            )

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    schema = "doc_id long, text_hash long, unit long, size long, print long, bands array<long>"
    return rows.mapInPandas(lean(run), schema)


def _sets(asked: DataFrame, units: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """``unit, shingles`` of the units asked for, stored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shingles = [shingle_set(t, words).view(np.int64).tolist() for t in batch["text"]]
            yield pd.DataFrame({"unit": batch["unit"], "shingles": shingles})

    asked = asked.distinct().join(units.select("unit", "text_hash"), "unit")
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(asked, "text_hash")
    texts = texts.dropDuplicates(["unit"]).select("unit", "text")
    return stored(texts.mapInPandas(lean(run), "unit long, shingles array<long>"))


def _similar(pairs: DataFrame, units: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` of units whose sets of shingles have at least this Jaccard similarity, stored."""
    with scope(docs.sparkSession) as own:
        return own.keep(_similar_pairs(pairs, units, docs, words, similarity))


def _similar_pairs(pairs: DataFrame, units: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    sizes = units.select("unit", "size", "text_hash")
    left = sizes.select(F.col("unit").alias("a"), F.col("size").alias("size_a"))
    right = sizes.select(F.col("unit").alias("b"), F.col("size").alias("size_b"))
    fits = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * F.lit(similarity)
    pairs = stored(pairs.where("a != b").distinct().join(left, "a").join(right, "b").where(fits))
    sets = _sets(pairs.select(F.col("a").alias("unit")).union(pairs.select("b")), units, docs, words)
    both = pairs.join(sets.select(F.col("unit").alias("a"), F.col("shingles").alias("of_a")), "a")
    both = both.join(sets.select(F.col("unit").alias("b"), F.col("shingles").alias("of_b")), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(common >= F.lit(similarity) * (F.col("size_a") + F.col("size_b") - common)).select("a", "b")


def _settled(edges: DataFrame) -> DataFrame:
    """``unit, root`` of the components, stored; their rounds are dropped."""
    with scope(edges.sparkSession) as own:
        return own.keep(components(edges).toDF("unit", "root"))


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each set of ``left`` shares with each of ``right``; only shingles of two sets or more count."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    often = times[column] > 1
    column, owner = (np.cumsum(times > 1) - 1)[column[often]], owner[often]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, [at, at + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        has[owner[low:high], column[low:high] - at] = 1
        out += has[left] @ has[right].T
    return out


def _least_of_links(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric table of links the least row of its component."""
    label = np.arange(len(near))
    while True:
        least = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
        least = least[least]
        if np.array_equal(least, label):
            return label
        label = least


def _across(
    members: DataFrame, roots: DataFrame, units: DataFrame, docs: DataFrame, words: int, similarity: float
) -> DataFrame:
    """Links ``(a, b)`` that connect the units which share a band, are not yet of one class, and are similar; stored.

    A band of two units is a pair. The units of a larger one are dealt, with their shingles, to blocks of about BLOCK
    units and MASS shingles. Two blocks meet in one step, which compares the sets there and then and returns one link
    for each unit at most, so no pair of a large group is ever a row, and neither a class nor a band is one row or one
    group, however large it is.
    """
    with scope(docs.sparkSession) as own:
        rooted = members.join(roots, "unit", "left").withColumn("root", F.coalesce("root", "unit"))
        bands = rooted.groupBy("key").agg(
            F.count("*").alias("n"), F.sum("size").alias("mass"), F.min("root").alias("low"), F.max("root").alias("high"),
            F.min("unit").alias("a"), F.max("unit").alias("b"),
        )
        bands = stored(bands.where("low != high"))
        two = _similar(bands.where("n = 2").select("a", "b"), units, docs, words, similarity)
        parts = F.ceil(F.greatest(F.col("n") / F.lit(float(BLOCK)), F.col("mass") / F.lit(float(MASS)))).cast("long")
        many = stored(rooted.join(bands.where("n > 2").select("key", parts.alias("parts")), "key"))
        many = many.join(_sets(many.select("unit"), units, docs, words), "unit").withColumn("own", F.pmod(F.xxhash64("unit"), F.col("parts")))
        many = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        pair = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
        blocks = many.select("key", *pair, "unit", "root", "size", "own", "shingles").groupBy("key", "i", "j")

        def meet(block: pd.DataFrame) -> pd.DataFrame:
            found = links_of(block)
            if len(block) >= BLOCK // 2:  # what a large block took is not for the next stages to carry
                give_back()
            return found

        def links_of(block: pd.DataFrame) -> pd.DataFrame:
            unit, root, size, own = (block[c].to_numpy() for c in ("unit", "root", "size", "own"))
            left = np.flatnonzero(own == block["i"].iat[0])
            right = np.flatnonzero(own == block["j"].iat[0])
            a, b = size[left][:, None], size[right][None, :]
            fits = np.minimum(a, b) >= similarity * np.maximum(a, b)
            fits &= root[left][:, None] != root[right][None, :]
            left, right = left[fits.any(axis=1)], right[fits.any(axis=0)]
            none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
            if not len(left):
                return none
            fits = fits[fits.any(axis=1)][:, fits.any(axis=0)]
            taken = np.union1d(left, right)
            left, right = np.searchsorted(taken, left), np.searchsorted(taken, right)
            unit, size = unit[taken], size[taken]
            common = _shared([np.asarray(x, dtype=np.int64) for x in block["shingles"].iloc[taken]], left, right)
            fits &= common >= similarity * (size[left][:, None] + size[right][None, :] - common)
            if not fits.any():
                return none
            near = np.zeros((len(unit), len(unit)), dtype=bool)
            near[np.ix_(left, right)] = fits
            least = _least_of_links(near | near.T)
            moved = least != np.arange(len(unit))
            return pd.DataFrame({"a": unit[moved], "b": unit[least[moved]]})

        return own.keep(two.union(blocks.applyInPandas(meet, "a long, b long")))


def near_copy_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 6) -> DataFrame:
    """``doc_id, text_hash, root``: classes of texts linked by a Jaccard similarity of at least ``similarity``.

    Candidates are units that share a MinHash band, and SimHash fingerprints linked by covering masks. No candidate is
    a link before the sets of shingles themselves are compared. First each unit meets the least unit of its bands, and
    the fingerprints' links are tried. Then in each band the units of different classes meet, block by block, and are
    compared there, so a large class of near copies costs a row for each and not one for each pair. Only a pair that shares no band and no mask is missed.

    NULL texts and texts without words are one unit; a NULL id gets a class; an empty table gives no rows.
    """
    rows = stored(sketches(docs, words))
    units = stored(rows.select("unit", "size", "print", "bands", "text_hash").dropDuplicates(["unit"]))
    members = units.select("unit", "size", F.explode("bands").alias("key"))
    buckets = stored(members.groupBy("key").agg(F.count("*").alias("n"), F.min("unit").alias("a")).where("n > 1").select("key", "a"))
    members = stored(members.join(buckets, "key"))
    first = members.groupBy("unit").agg(F.min("a").alias("a")).select("a", F.col("unit").alias("b"))

    leads = stored(units.groupBy("print").agg(F.min("unit").alias("lead")))
    same = units.join(leads, "print").select(F.col("lead").alias("a"), F.col("unit").alias("b"))
    with scope(docs.sparkSession) as own:
        near = own.keep(links(leads.select("print"), radius).toDF("p", "q"))
    near = near.join(leads.select(F.col("print").alias("p"), F.col("lead").alias("a")), "p")
    near = near.join(leads.select(F.col("print").alias("q"), F.col("lead").alias("b")), "q").select("a", "b")
    tried = first.union(same).union(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = _similar(tried, units, docs, words, similarity)

    more = _across(members.select("key", "unit", "size"), _settled(found), units, docs, words, similarity)
    roots = _settled(found.union(more))
    return rows.join(roots, "unit", "left").select("doc_id", "text_hash", F.coalesce("root", "unit").alias("root"))


def without_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 6) -> DataFrame:
    """The rows of ``docs``, with all their columns, without near copies: the least doc_id of each class stays."""
    with scope(docs.sparkSession) as own:
        classes = own.keep(near_copy_classes(docs, words, similarity, radius))
    return first_of_each(docs, classes)


by_value(__name__)
