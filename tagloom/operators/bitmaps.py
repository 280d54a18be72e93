"""Who has which tag value: member chunks, native bitmaps and id sets.

Every form is cut by bucket of 32,768 consecutive ids, so no row and no group grows with the number of
users, however popular a value is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.packing import SIGNED, WORD_BITS, IdSpace, bit_mask, bitmap_of, block_of, word_of
from tagloom.sources.catalog import TagSpec

VALUE_KEYS = ("tag_code", "tag_value")


def unpivot_tags(
    wide: DataFrame,
    codes: Sequence[str],
    ids: Sequence[str] = ("uid",),
    value_types: Sequence[str] | None = None,
) -> DataFrame:
    """One row per user and non-empty cell: ``(uid, tag_code, tag_value)``, and ``value_type`` if given.

    The code keeps the case it has in the catalogue while the column it names is lower case.
    """
    if not codes:
        raise ValueError("no tag to unpivot")
    # Exploding an array keeps the partitioning of the wide rows; Spark's unpivot would lose it.
    cells = F.array(
        *(
            F.struct(
                F.lit(c).alias("tag_code"),
                F.col(f"`{c.lower()}`").alias("tag_value"),
                *([F.lit(value_types[i]).alias("value_type")] if value_types else []),
            )
            for i, c in enumerate(codes)
        )
    )
    return wide.select(*ids, F.inline(cells)).filter(F.col("tag_value") != "")


def members_of_wide(
    wide: DataFrame,
    codes: Sequence[str],
    strict: bool = True,
    value_types: Sequence[str] | None = None,
    ids: IdSpace = SIGNED,
) -> DataFrame:
    """Members of all tag values, ``(tag_code, tag_value, bucket, block, position)``, from the wide table.

    ``ids`` is SIGNED or UNSIGNED, and must be the same wherever these members are read.

    The wide row is shuffled by block of 1,024 ids before it is unpivoted: a user crosses the network once, not
    once per tag, and the words of a block are built in place. What is left to bring together by bucket is packed.
    """
    member = ids.read(F.col("uid"), strict)
    placed = (
        wide.select("*", member.alias("_member"))
        .filter(F.col("_member").isNotNull())
        .withColumns({"bucket": ids.bucket(F.col("_member")), "position": ids.position(F.col("_member"))})
        .withColumn("block", block_of(F.col("position")))
        .drop("uid", "_member")
        .repartition("bucket", "block")
    )
    return unpivot_tags(placed, codes, ("bucket", "block", "position"), value_types)


def members_of_tall(tall: DataFrame, strict: bool = True, ids: IdSpace = SIGNED) -> DataFrame:
    """The same from ``(uid, tag_code, tag_value)`` rows, in which a user may repeat.

    Repeats are dropped before the rows are placed by bucket, so a user holding a large share of the
    rows leaves each map task once per value.
    """
    member = ids.read(F.col("uid"), strict)
    rows = tall.filter(F.col("tag_value") != "").select(*VALUE_KEYS, member.alias("_member"))
    placed = rows.filter(F.col("_member").isNotNull()).select(
        *VALUE_KEYS,
        ids.bucket(F.col("_member")).alias("bucket"),
        ids.position(F.col("_member")).alias("position"),
    )
    placed = placed.withColumn("block", block_of(F.col("position")))
    return placed.distinct().repartition("bucket", "block")


def user_chunks(members: DataFrame) -> DataFrame:
    """Packed members: ``(tag_code, tag_value, bucket, n_users, words array<(word, bits)>)``.

    The bits of a word are or-ed together, which also drops repeats, and only words with a bit are
    kept: a rare value costs one word, a value everybody has costs 512 words for 32,768 users.
    """
    keys = [*VALUE_KEYS, *(["value_type"] if "value_type" in members.columns else [])]
    words = members.groupBy(*keys, "bucket", "block", word_of(F.col("position")).alias("word")).agg(
        F.bit_or(bit_mask(F.col("position"))).alias("bits")
    )
    return words.groupBy(*keys, "bucket").agg(
        F.sum(F.bit_count("bits")).alias("n_users"),
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"),
    )


def user_counts(chunks: DataFrame) -> DataFrame:
    """Distinct users of each tag value, from any of the chunked forms."""
    return chunks.groupBy(*VALUE_KEYS).agg(F.sum("n_users").alias("n_users"))


def chunk_users(chunks: DataFrame, ids: IdSpace = SIGNED) -> DataFrame:
    """Packed members back to ids, with the columns before the bucket: ``(tag_code, tag_value, uid)``.

    A signed uid is a bigint, an unsigned one a decimal(20,0).
    """
    keys = [c for c in VALUE_KEYS if c in chunks.columns]
    words = chunks.select(*keys, "bucket", F.inline("words"))
    every = F.sequence(F.lit(0), F.lit(WORD_BITS - 1))
    members = F.filter(every, lambda bit: F.bit_get(F.col("bits"), bit) == 1)
    bits = words.select(*keys, "bucket", "word", F.explode(members).alias("bit"))
    position = F.col("word") * WORD_BITS + F.col("bit")
    return bits.select(*keys, ids.id_of(F.col("bucket"), position.cast("bigint")).alias("uid"))


def user_bitmaps(members: DataFrame) -> DataFrame:
    """Members as Spark's own 4,096-byte bitmaps: ``(tag_code, tag_value, bucket, n_users, bitmap)``.

    For use with ``bitmap_or_agg`` and ``bitmap_and_agg``. A chunk has the same size whatever it holds,
    so rare values are better kept as ``user_chunks``.

    Bitmaps are laid out from packed words, row by row, after the last shuffle and sort: neither ever holds one, whatever
    the number of values. Rows come sorted by tag and bucket, so that or-ing the values of a tag needs no sort either.
    """
    chunks = user_chunks(members.drop("value_type")).sortWithinPartitions("tag_code", "bucket")
    return chunks.select(*VALUE_KEYS, "bucket", "n_users", bitmap_of(F.col("words")).alias("bitmap"))


def user_sets(members: DataFrame, ids: IdSpace = SIGNED) -> DataFrame:
    """Members as sorted id arrays of one bucket each: ``(tag_code, tag_value, bucket, n_users, uids)``.

    Sets are read from packed words: a word is or-ed as one number, and its bits become ids once, in order.
    """
    bucket = F.col("bucket")
    every = F.sequence(F.lit(0), F.lit(WORD_BITS - 1))

    def of_word(word: Column) -> Column:
        own = F.filter(every, lambda bit: F.bit_get(word["bits"], bit) == 1)
        return F.transform(own, lambda bit: ids.id_of(bucket, (word["word"] * WORD_BITS + bit).cast("bigint")))

    # Below zero, signed positions count away from zero.
    uids = F.flatten(F.transform("words", of_word))
    ordered = uids if ids is not SIGNED else F.when(bucket > 0, uids).otherwise(F.reverse(uids))
    return user_chunks(members).select(*VALUE_KEYS, "bucket", "n_users", ordered.alias("uids"))


def chunks_by_type(wide: DataFrame, specs: Sequence[TagSpec], ids: IdSpace = SIGNED) -> DataFrame:
    """Packed members of all tags with the tag's ``value_type``, in one pass over the wide table."""
    types = [s.value_type for s in specs]
    return user_chunks(members_of_wide(wide, [s.code for s in specs], value_types=types, ids=ids))
