"""SimHash fingerprints of word shingles, linked by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import bounded_batches, by_value, lean, stored
from tagloom.llm.graph import components

BITS = 64
CHUNK = 1 << 17  # shingles whose bits are counted at a time
BLOCK = 1024  # fingerprints of a bucket compared at a time
TABLES = 32  # masks whose buckets are made at a time
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str, words: int) -> Iterator[list[int]]:
    """XXH64 (seed 42) of each shingle, in chunks; the whole sequence if it has fewer words."""
    parts = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(parts)
    if len(parts) < words:
        yield [digest(joined, 42)]
        return
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1, out=starts[1:])
    ends = (starts[words:] - 1).tolist()
    begins = starts[: len(ends)].tolist()
    for at in range(0, len(ends), CHUNK):
        yield [digest(joined[a:b], 42) for a, b in zip(begins[at : at + CHUNK], ends[at : at + CHUNK], strict=True)]


def fingerprints_of(texts: list[str | None], words: int) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each text; 0 for texts without words."""
    ones = np.zeros((len(texts), BITS), dtype=np.int64)
    total = np.zeros(len(texts), dtype=np.int64)
    hashes: list[int] = []
    owner: list[int] = []
    starts: list[int] = []

    def count() -> None:
        if hashes:
            bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
            np.add.at(ones, owner, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
            hashes.clear(), owner.clear(), starts.clear()

    for i, text in enumerate(texts):
        for chunk in shingle_hashes(text or "", words):
            starts.append(len(hashes))
            owner.append(i)
            hashes.extend(chunk)
            total[i] += len(chunk)
            if len(hashes) >= CHUNK:
                count()
    count()
    return np.packbits(2 * ones > total[:, None], axis=1).reshape(-1, 8).view(">u8").astype(np.uint64).reshape(-1)


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, text_hash, print`` (the fingerprint's bits as a signed number)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = fingerprints_of(batch["text"].tolist(), words).view(np.int64)
            ids = batch["doc_id"].astype("Int64")
            yield pd.DataFrame({"doc_id": ids, "text_hash": batch["text_hash"], "print": prints})

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInPandas(lean(run), "doc_id long, text_hash long, print long")


def covering_masks(radius: int) -> list[int]:
    """Signed 64-bit masks such that any two fingerprints within the radius agree on one of them.

    Bit i gets a non-zero vector of r + 1 binary places; the mask of a non-zero vector v keeps the bits whose vector
    has odd overlap with v. The vectors of r differing bits never span all r + 1 places, so some v has even overlap
    with each of them, and its mask keeps none of them. Below radius 6 the bits take the vectors in turn. At radius 6
    bit i has ``64 + i``, which is the first-order Reed-Muller code: one mask keeps all bits, the others 32 each.
    """
    if not 0 <= radius <= 6:
        raise ValueError("a 64-bit fingerprint has masks for a radius of 0 to 6")
    vectors = 2 ** (radius + 1) - 1
    of_bit = [64 + i if radius == 6 else i % vectors + 1 for i in range(BITS)]
    masks = []
    for v in range(1, vectors + 1):
        mask = sum(1 << i for i in range(BITS) if (of_bit[i] & v).bit_count() % 2)
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return masks


def _forest(prints: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the least one of its component within this block."""
    order = np.argsort(prints)
    own = prints[order]
    label = np.arange(len(own))
    near = np.bitwise_count((own[:, None] ^ own[None, :]).view(np.uint64)) <= radius
    while True:
        least = np.where(near, label[None, :], len(own)).min(axis=1)
        least = least[least]
        if np.array_equal(least, label):
            break
        label = least
    out = np.empty_like(own)
    out[order] = own[label]
    return out


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints within the radius of each other.

    ``prints`` has distinct fingerprints ``print``. They fall into a bucket for each covering mask, TABLES masks at a
    time. A bucket of two is one comparison. A larger one is cut to blocks of about BLOCK by a hash, each pair of
    blocks is compared in one step, and a block returns its spanning links, one for each fingerprint at most, instead
    of all pairs.
    """
    masks = covering_masks(radius)
    # A small table of fingerprints would be one task, and each becomes a row for each mask.
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(len(masks), TABLES))
    dealt = prints.repartition(tasks, "print")
    parts = [masks[at : at + TABLES] for at in range(0, len(masks), TABLES)]
    return reduce(DataFrame.union, [stored(_table_links(dealt, part, radius)) for part in parts]).distinct()


def _table_links(prints: DataFrame, masks: list[int], radius: int) -> DataFrame:
    masked = F.array(*[F.col("print").bitwiseAND(F.lit(mask)) for mask in masks])
    keyed = prints.select("print", F.posexplode(masked).alias("table", "key"))
    buckets = keyed.groupBy("table", "key").agg(
        F.count("*").alias("n"), F.min("print").alias("a"), F.max("print").alias("b")
    )
    buckets = stored(buckets.where("n > 1"))
    two = buckets.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")

    parts = F.ceil(F.col("n") / F.lit(float(BLOCK))).cast("long")
    many = keyed.join(buckets.where("n > 2").select("table", "key", "n"), ["table", "key"]).withColumn("parts", parts)
    many = many.withColumn("own", F.pmod(F.xxhash64("print"), F.col("parts")))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pair = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    blocks = (
        many.select("print", "table", "key", *pair)
        .groupBy("table", "key", "i", "j")
        .agg(F.array_sort(F.collect_list("print")).alias("prints"))
        .groupBy(F.xxhash64("prints").alias("h"), F.size("prints").alias("n"))
        .agg(F.first("prints").alias("prints"))
        .select("prints")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.empty((0, 2), dtype=np.int64)]
            for block in batch["prints"]:
                own = np.asarray(block, dtype=np.int64)
                least = _forest(own, radius)
                moved = least != own
                found.append(np.column_stack([own[moved], least[moved]]))
            pairs = np.concatenate(found)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return two.union(blocks.mapInPandas(lean(compare), "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """The class of near copies of every document.

    ``docs`` needs doc_id and text. Returns doc_id, fingerprint (16 lowercase hex digits), print (the same as a
    number), root (the class by its least fingerprint), component_id (its least doc_id) and text_hash.

    Copies share a fingerprint and are handled once; links and components are found among distinct fingerprints,
    and none of them passes through the driver. NULL and empty texts have fingerprint 0 and are linked like any
    other; rows with a NULL id get a class but never name it; repeated rows are classed each; an empty table gives
    no rows.
    """
    rows = stored(fingerprints(docs, words))
    prints = stored(rows.groupBy("print").agg(F.min("doc_id").alias("least_id")))
    roots = stored(components(links(prints.select("print"), radius)))
    rooted = prints.join(roots.withColumnRenamed("node", "print"), "print", "left")
    rooted = stored(rooted.withColumn("root", F.coalesce("root", "print")))
    classes = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.select("print", "root").join(classes, "root")
    return rows.join(named, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "print", "root", "component_id", "text_hash"
    )


def one_of_each(docs: DataFrame, words: int = 5, radius: int = 6) -> DataFrame:
    """The rows of ``docs``, with all their columns, without near copies: the least doc_id of each class stays.

    A row without an id stays only where its class has no id; of equal rows one stays.
    """
    classes = near_duplicates(docs, words, radius)
    return first_of_each(docs, classes.select("doc_id", "text_hash", "root"))


def first_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``docs`` that come first in their class; ``classes`` has doc_id, text_hash and root.

    The row travels as one struct, so columns of any name come back as they were.
    """
    counted = classes.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash", "n")).alias("first")
    kept = counted.groupBy("root").agg(first)
    kept = stored(kept.select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash"), "first.n"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")))
    # Of rows that agree in id and text one stays; the aggregate leaves one of them for each map task.
    other = F.xxhash64(F.to_json(F.struct(*(F.col("row").getField(c).cast("string").alias(f"c{i}") for i, c in enumerate(docs.columns)))))
    among = rows.where("n > 1").groupBy("id", "hash").agg(F.min_by("row", other).alias("row"))
    kept_rows = rows.where("n = 1").select("row").union(among.select("row"))
    return kept_rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


by_value(__name__)
