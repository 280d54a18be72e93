"""Packing of numeric member ids.

An id belongs to a bucket of ``CHUNK_SIZE`` consecutive ids and has a position inside it. A position is one bit of
one 64-bit word, so a bucket has 512 words. Signed ids use Spark's own ``bitmap_*`` numbering. Unsigned ids, 0 to
2^64 - 1, are kept as the bigint with the same 64 bits: the upper 49 bits are the bucket, the lower 15 the position,
so buckets are in the order of the ids and nothing overflows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_SIZE = 32768
WORD_BITS = 64


def numeric_id(uid: Column, strict: bool = True) -> Column:
    """Member id as bigint; lenient mode makes a non-numeric id NULL."""
    return uid.cast("bigint") if strict else uid.try_cast("bigint")


def bucket_of(member: Column) -> Column:
    return F.bitmap_bucket_number(member)


def position_of(member: Column) -> Column:
    return F.bitmap_bit_position(member)


def member_id(bucket: Column, position: Column) -> Column:
    """Inverse of ``bucket_of`` and ``position_of``."""
    return F.when(bucket > 0, (bucket - 1) * CHUNK_SIZE + position + 1).otherwise(
        bucket * CHUNK_SIZE - position
    )


def word_of(position: Column) -> Column:
    return F.shiftright(position, 6).cast("int")


def block_of(position: Column) -> Column:
    """Sixteen words, 1,024 ids: what one task packs at a time."""
    return F.shiftright(position, 10).cast("int")


def bit_mask(position: Column) -> Column:
    """A bigint with only this position's bit set."""
    return F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), position.bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")
    )


def bitmap_of(words: Column) -> Column:
    """Spark's bitmap of a bucket, 4,096 bytes, from its sorted ``(word, bits)``: bytes of a word stand lowest first."""
    low = F.lit(0x0F0F0F0F0F0F0F0F)

    def digits(word: Column, i: Column) -> Column:
        gap = word["word"] - F.coalesce(F.get(words, i - 1)["word"], F.lit(-1)) - 1
        # Digits change places inside each byte, so that the reversed text has the bytes in reverse.
        bits = F.shiftleft(word["bits"].bitwiseAND(low), 4).bitwiseOR(F.shiftrightunsigned(word["bits"], 4).bitwiseAND(low))
        return F.concat(F.repeat(F.lit("0" * 16), gap), F.reverse(F.lpad(F.hex(bits), 16, "0")))

    return F.unhex(F.rpad(F.array_join(F.transform(words, digits), ""), CHUNK_SIZE // 4, "0" * 512))


def unsigned_id(uid: Column, strict: bool = True) -> Column:
    """An id from 0 to 2^64 - 1 as the bigint with the same bits; ``strict`` fails on anything else, else it is NULL."""
    text = uid.cast("string")
    whole = F.when(text.rlike(r"^\s*\+?0*[0-9]{1,20}\s*$"), F.trim(text)).try_cast("decimal(38,0)")
    half = F.lit(Decimal(1 << 63)).cast("decimal(38,0)")
    value = F.when(whole < half + half, whole)
    # Above 2^63 the same bits are the negative number 2^64 below.
    bits = F.when(value < half, value.cast("bigint")).otherwise((value - half - half).cast("bigint"))
    if not strict:
        return bits
    wrong = F.raise_error(F.concat(F.lit("no unsigned 64-bit id: "), text)).cast("bigint")
    return F.when(text.isNotNull(), F.coalesce(bits, wrong))


def unsigned_value(bits: Column) -> Column:
    """Inverse of ``unsigned_id``: the id as decimal(20,0)."""
    value = bits.cast("decimal(20,0)")
    return F.when(bits < 0, value + F.lit(Decimal(1 << 64)).cast("decimal(20,0)")).otherwise(value).cast("decimal(20,0)")


@dataclass(frozen=True)
class IdSpace:
    """How ids are read, placed and written back."""

    read: Callable[[Column, bool], Column]
    bucket: Callable[[Column], Column]
    position: Callable[[Column], Column]
    id_of: Callable[[Column, Column], Column]


SIGNED = IdSpace(numeric_id, bucket_of, position_of, member_id)
UNSIGNED = IdSpace(
    unsigned_id,
    lambda bits: F.shiftrightunsigned(bits, 15),
    lambda bits: bits.bitwiseAND(F.lit(CHUNK_SIZE - 1)),
    lambda bucket, position: unsigned_value(F.shiftleft(bucket.cast("bigint"), 15).bitwiseOR(position.cast("bigint"))),
)
