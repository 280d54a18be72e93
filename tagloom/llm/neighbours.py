"""Approximate nearest neighbours by cross-polytope hashing with probes and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import by_value, stored
from tagloom.llm.topk import usable

BLOCK, ASKING = 2048, 1024  # vectors and queries of a bucket that meet in one step


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Rows times the orthonormal Hadamard matrix; their width is a power of two."""
    n, width = rows.shape
    half = 1
    while half < width:
        pairs = rows.reshape(n, -1, 2, half)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return rows / np.sqrt(width)


class CrossPolytope:
    """Pseudo-random rotations H D3 H D2 H D1 and the nearest signed axes after them.

    If lengths differ, a vector is completed to the greatest length by one more component, so that the largest inner
    product is the smallest angle; queries get 0 there.
    """

    def __init__(self, width: int, tables: int, least: float, greatest: float, seed: int):
        self.completed = greatest if greatest - least > 1e-3 * greatest else None
        self.width = width
        self.padded = 1 << max(1, (width + (self.completed is not None) - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, 3, self.padded))

    def matrix(self, vectors: pd.Series) -> np.ndarray:
        out = np.zeros((len(vectors), self.width))
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def axes(self, rows: np.ndarray, table: int, probes: int, asking: bool) -> np.ndarray:
        """The ``probes`` nearest axes of each row, nearest first; axis i + padded is minus axis i."""
        turned = np.zeros((len(rows), self.padded))
        turned[:, : self.width] = rows
        if self.completed is not None and not asking:
            turned[:, self.width] = np.sqrt(np.maximum(self.completed**2 - (rows**2).sum(axis=1), 0.0))
        for signs in self.signs[table]:
            turned = hadamard(turned * signs)
        return np.argsort(-np.concatenate([turned, -turned], axis=1), axis=1, kind="stable")[:, :probes]


def _hashed(distinct: DataFrame, index: CrossPolytope, tables: list[int], probes: int, asking: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = index.matrix(batch["vector"])
            raw = [r.tobytes() for r in rows]
            for table in tables:
                axes = index.axes(rows, table, probes, asking)
                n = axes.shape[1]
                yield pd.DataFrame(
                    {
                        "uid": np.repeat(batch["uid"].to_numpy(), n),
                        "ids": [i for i in batch["ids"] for _ in range(n)],
                        "vector": [r for r in raw for _ in range(n)],
                        "table": table,
                        "axis": axes.ravel(),
                    }
                )

    schema = "uid long, ids array<long>, vector binary, table int, axis int"
    return distinct.select("uid", "ids", "vector").mapInPandas(run, schema)


def _met(members: DataFrame, asking: DataFrame, width: int, keep: int) -> DataFrame:
    """``uid, vec_id, score``: the best ``keep`` of each bucket for each query that probes it.

    A bucket is cut to blocks of about BLOCK vectors and ASKING queries by hash, and each block of the one meets
    each block of the other in a step of its own, so a full bucket is many small steps.
    """
    bucket = ["table", "axis"]
    n = members.groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    q = asking.groupBy(*bucket).agg(F.ceil(F.count("*") / ASKING).alias("q_parts"))
    grid = stored(n.join(q, bucket))

    def dealt(rows: DataFrame, own: str, parts: str, other: str, q_parts: str) -> DataFrame:
        rows = rows.join(grid, bucket).withColumn(own, F.pmod(F.xxhash64("uid"), F.col(parts)))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(q_parts) - 1))
        return rows.withColumn(other, every).select("uid", "ids", "vector", *bucket, "part", "q_part")

    key = [*bucket, "part", "q_part"]
    left = dealt(members, "part", "parts", "q_part", "q_parts").groupBy(*key)
    right = dealt(asking, "q_part", "q_parts", "part", "parts").groupBy(*key)

    def meet(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(queries):
            return pd.DataFrame({"uid": [], "vec_id": [], "score": []}).astype({"uid": "int64", "vec_id": "int64"})
        own = np.frombuffer(b"".join(block["vector"]), dtype=float).reshape(-1, width)
        asked = np.frombuffer(b"".join(queries["vector"]), dtype=float).reshape(-1, width)
        rough = asked @ own.T
        ids = block["ids"].to_numpy()
        out: list[pd.DataFrame] = []
        for uid, vector, line in zip(queries["uid"], asked, rough, strict=True):
            at = np.arange(len(line))
            if len(line) > keep:
                kth = np.partition(line, len(line) - keep)[len(line) - keep]
                at = np.flatnonzero(line >= kth - 1e-9 * (1 + abs(kth)))
            score = (own[at] * vector).sum(axis=1)  # the same sum wherever a pair meets
            each = np.array([len(ids[a]) for a in at])
            vec_id, score = np.concatenate([ids[a] for a in at]).astype(np.int64), np.repeat(score, each)
            best = np.lexsort((vec_id, -score))[:keep]
            out.append(pd.DataFrame({"uid": uid, "vec_id": vec_id[best], "score": score[best]}))
        return pd.concat(out, ignore_index=True)

    found = left.cogroup(right).applyInPandas(meet, "uid long, vec_id long, score double")
    best = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc("vec_id"))
    found = found.groupBy("uid", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= keep).drop("n")


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    tables: int = 8,
    probes: int = 16,
    seed: int = 3,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Each query's k nearest found by inner product: query_id, rank, vec_id, score.

    In each of ``tables`` tables a vector lies in the bucket of its nearest signed axis after a pseudo-random
    rotation, and a query looks into the buckets of its ``probes`` nearest axes. What it meets there is ranked by the
    inner product of the original vectors in double precision, ties by the smaller id. A query that meets fewer
    than k rows looks into all buckets of one table.

    Equal vectors are one entry of the index with their k + 1 least ids, which is all that a ranking can use, and
    equal queries ask once. Vectors that are NULL or zero or hold NULL or non-finite components take no part, nor do
    rows without an id; shorter vectors are padded with zeros. A row never finds its own id; equal rows count once.
    An empty table gives no rows.
    """
    sound = F.col("vec_id").isNotNull() & usable(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")
    ).where(sound)
    keep = k + 1
    least_ids = Window.partitionBy("vector").orderBy("vec_id")
    distinct = (
        rows.select("vec_id", "vector")
        .withColumn("n", F.dense_rank().over(least_ids))
        .where(F.col("n") <= keep)  # cut before the shuffle as well
        .groupBy("vector")
        .agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
        .withColumn("uid", F.xxhash64("vector"))
    )
    distinct = stored(distinct)
    asks = stored(rows.where("asks").select("vec_id", F.xxhash64("vector").alias("uid")).distinct())
    asking = distinct.join(asks.select("uid").distinct(), "uid", "left_semi")

    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = distinct.agg(F.max(F.size("vector")), F.min(length), F.max(length)).first()
    width = size[0] or 1
    index = CrossPolytope(width, tables, size[1] or 0.0, size[2] or 0.0, seed)
    members = _hashed(distinct, index, list(range(tables)), 1, False)
    found = stored(_met(members, _hashed(asking, index, list(range(tables)), probes, True), width, keep))

    enough = found.groupBy("uid").count().where(F.col("count") >= keep)
    short = stored(asking.join(enough, "uid", "left_anti"))
    every = _met(members.where("table = 0"), _hashed(short, index, [0], 2 * index.padded, True), width, keep)
    found = found.join(short, "uid", "left_anti").union(every)

    lists = found.groupBy("uid").agg(F.collect_list(F.struct("score", "vec_id")).alias("found"))  # keep rows each
    own = asks.withColumnRenamed("vec_id", "query_id").join(lists, "uid")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (
        own.select("query_id", F.inline("found"))
        .where(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


by_value(__name__)
