"""Sharding by longest-processing-time scheduling: equal texts stay together, bytes are near equal."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import rank_within, stored


def longest_first(sizes: list[tuple[int, tuple]], shards: int) -> list[tuple[tuple, int]]:
    """The shard of each key: keys by falling size, each to the shard with the least bytes so far."""
    heap = [(0, shard) for shard in range(shards)]
    placed = []
    for size, key in sorted(sizes, key=lambda item: (-item[0], item[1])):
        load, shard = heapq.heappop(heap)
        placed.append((key, shard))
        heapq.heappush(heap, (load + size, shard))
    return placed


def shard_documents(docs: DataFrame, shards: int = 16, units: int = 1 << 16) -> DataFrame:
    """Deal documents to ``shards`` by bytes.

    ``docs`` needs doc_id and text. Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law ('bytes'), shard,
    slot (gapless from 0 in the shard) and grown_shard (NULL, as this law has none).

    What is scheduled is a group of equal texts if it holds more than ``1 / units`` of all bytes, and else one of
    ``units`` bundles of small groups, by the hash of the text. So the driver schedules 2 * units items at most,
    whatever the number of documents, and no bundle is larger than a few parts in ``units``. A text is known by
    two 64-bit hashes.

    NULL texts are one group of size 1 each, empty texts another. Repeated rows stay together and get a slot each.
    One group beyond a shard's share can't be split and makes its shard larger. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col("text")
    rows = stored(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(text.isNull(), text).alias("h1"),
            F.xxhash64(text, F.lit("second")).alias("h2"),
        )
    )
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    large = F.col("bytes") > F.lit(total / units)
    unit = groups.select(
        "bytes",
        F.when(large, F.col("h1")).otherwise(F.pmod("h1", F.lit(units))).alias("a"),
        F.when(large, F.col("h2")).alias("b"),
    )
    # at most units large groups and units bundles
    sizes = [(r.bytes, (r.b is not None, r.a, r.b or 0)) for r in unit.groupBy("a", "b").agg(F.sum("bytes").alias("bytes")).collect()]
    placed = longest_first(sizes, shards)
    own = spark.createDataFrame([(k[1], k[2], s) for k, s in placed if k[0]], "h1 long, h2 long, own int")
    bundle = spark.createDataFrame([(k[1], s) for k, s in placed if not k[0]], "bundle long, shared int")
    dealt = (
        rows.withColumn("bundle", F.pmod("h1", F.lit(units)))
        .join(F.broadcast(own), ["h1", "h2"], "left")  # both have units rows at most
        .join(F.broadcast(bundle), "bundle", "left")
        .select("doc_id", "size", "text_crc32", "h1", F.coalesce("own", "shared").alias("shard"))
    )
    return rank_within(dealt, ["shard"], ["doc_id", "h1"], "slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
