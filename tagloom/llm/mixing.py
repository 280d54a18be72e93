"""Mixing sources to target weights: whole epochs first, then a weighted sample without replacement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import WORD, scope, stored

# Characters that lower a document's quality weight: marks of tables, markup and noise.
SYMBOLS = "%$#&*|!<>{}[]=_~^@+\\/"


def quality_weight(text: Column) -> Column:
    """From 0.25 to 1, falling with the share of symbols in the text; texts without characters get 1."""
    length = F.length(text)
    share = (length - F.length(F.translate(text, SYMBOLS, ""))) / length
    return F.when(length > 0, F.greatest(F.lit(0.25), F.lit(1.0) - F.lit(2.0) * share)).otherwise(F.lit(1.0))


def uniform(doc_id: Column, size: Column, seed: int) -> Column:
    """A number inside (0, 1) from 52 bits of the MD5 of seed, id and size; reruns agree."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16**13))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``(missing, name, source_size)`` with ``target`` added.

    Sources in code-point order, NULL last, get the weights in turn and share the sum of all sizes by them. A target
    stops at ``cap`` times its source's size, and the excess goes to the others by weight. In order of
    ``cap * size / weight`` the stopped sources come first, so the level at which nobody is above its limit is the
    largest of what remains for each position. One row for each source goes through these windows.
    """
    order = Window.orderBy("missing", "name")
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    limit = F.lit(float(cap)) * F.col("source_size")
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "missing", "name")
    earlier, later = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("limit", limit)
        .withColumn("level", left / F.sum("weight").over(later))
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least(F.col("limit"), F.col("weight") * F.col("level")))
        .select("missing", "name", "source_size", "target")
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    cap: int = 3,
    seed: int = 7,
    slices: int = 4096,
) -> DataFrame:
    """How many words of each document the mix takes.

    ``docs`` needs doc_id, text and source; other columns are not read. Returns one row for each input row:
    doc_id, source, size (words), source_size, target (of the source), taken (words, repeats counted), copies (how
    often the document is taken) and text_hash.

    Efraimidis-Spirakis: a document's key is ``-ln(u) / weight`` for a repeatable uniform ``u`` and its quality
    weight. A source takes ``floor(target / size)`` complete epochs; the rest of the target is filled in key order,
    up to the document whose half still fits, so a source misses its target by half a document at most.

    Keys are cut to slices, which are summed before single documents are looked at: a source that holds a third of
    all rows is dealt to thousands of groups. A NULL text has size 0, a NULL source is a source of its own, repeated
    rows count each, and an empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(
        F.col("doc_id"),
        F.col("source").isNull().alias("missing"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"),
        F.xxhash64("text").alias("text_hash"),
        size.alias("size"),
        quality_weight(F.coalesce(F.col("text"), F.lit(""))).alias("quality"),
    )
    key = -F.log(uniform(F.col("doc_id"), F.col("size"), seed)) / F.col("quality")
    rows = rows.withColumn("key", key).drop("quality")
    rows = rows.withColumn("slice", F.floor(F.lit(slices) * (F.lit(1.0) - F.exp(-F.col("key")))).cast("int"))
    rows = stored(rows)

    group = ["missing", "name"]
    sums = rows.groupBy(*group, "slice").agg(F.sum("size").alias("slice_size"))
    by_source = Window.partitionBy(*group)
    before = by_source.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, "slice", F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("start"))
    targets = source_targets(rows.groupBy(*group).agg(F.sum("size").alias("source_size")), weights, cap)
    plan = starts.join(targets, group)

    epochs = F.when(
        F.col("source_size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("source_size")))
    ).otherwise(F.lit(0))
    in_slice = Window.partitionBy(*group, "slice").orderBy("key", "doc_id", "size")
    earlier = F.coalesce(F.sum("size").over(in_slice.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    fits = F.col("start") + earlier + F.col("size") / F.lit(2.0) <= rest
    return (
        rows.join(plan, [*group, "slice"])
        .withColumn("epochs", epochs.cast("long"))
        .withColumn("copies", F.col("epochs") + F.when(fits & (F.col("epochs") < cap), 1).otherwise(0))
        .select(
            "doc_id",
            F.when(~F.col("missing"), F.col("name")).alias("source"),
            "size",
            "source_size",
            "target",
            (F.col("size") * F.col("copies")).cast("long").alias("taken"),
            F.col("copies").cast("long").alias("copies"),
            "text_hash",
        )
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them.

    Equal rows share the copies that the mix takes of them: each has its share, rounded down, and the
    first of them have one more. A NULL text has no words and is taken as often as
    its source's complete epochs say; NULL ids and sources are values of their own; an empty table gives no rows. The
    row travels as one struct, so columns of any name come back as they were.
    """
    key = ["id", "hash", "source"]
    with scope(docs.sparkSession) as own:
        taken = mix(docs, weights, cap, seed).groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "source")
        taken = own.keep(taken.agg(F.sum("copies").alias("copies"), F.count("*").alias("n")))
    taken = taken.select(*(F.col(k).alias(f"of_{k}") for k in key), "copies", "n")
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.col("source").cast("string").alias("source")
    )
    rows = rows.join(taken, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in key)))
    # A row that stands alone needs no turn; only rows that agree in id, text and source are numbered.
    alone = rows.where("n = 1").select("row", F.col("copies").cast("int").alias("share"))
    turn = F.row_number().over(Window.partitionBy(*(f"of_{k}" for k in key)).orderBy(F.lit(1)))
    share = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("turn") <= F.col("copies") % F.col("n"), 1).otherwise(0)
    among = rows.where("n > 1").withColumn("turn", turn).select("row", share.cast("int").alias("share"))
    every = alone.union(among).where("share > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("share"))))
    return every.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
