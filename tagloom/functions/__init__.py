"""Column-level helpers: value types and casts, decodes, and member-id packing."""

from .packing import CHUNK_SIZE, SIGNED, UNSIGNED, WORD_BITS, IdSpace, bucket_of, member_id, position_of
from .values import (
    DATE,
    DECIMAL,
    LONG,
    TEXT,
    VALUE_TYPES,
    cast_value,
    check_day,
    column_type,
    day_suffix,
    decode_label,
    lookup_code,
)

__all__ = [
    "CHUNK_SIZE",
    "DATE",
    "DECIMAL",
    "LONG",
    "SIGNED",
    "TEXT",
    "UNSIGNED",
    "VALUE_TYPES",
    "WORD_BITS",
    "IdSpace",
    "bucket_of",
    "cast_value",
    "check_day",
    "column_type",
    "day_suffix",
    "decode_label",
    "lookup_code",
    "member_id",
    "position_of",
]
