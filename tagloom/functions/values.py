"""Tag value types, typed casts, decodes and day helpers."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Value-type codes of a tag definition and the column type each one is stored as.
# Dates are kept as ISO text.
LONG = "1"
DECIMAL = "2"
TEXT = "3"
DATE = "4"
VALUE_TYPES = {
    LONG: "bigint",
    DECIMAL: "decimal(16,2)",
    TEXT: "string",
    DATE: "string",
}

_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")
_ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def column_type(value_type: str) -> str:
    """The Spark type a tag of this value type is stored as."""
    try:
        return VALUE_TYPES[value_type]
    except KeyError:
        raise ValueError(
            f"unknown tag value type {value_type!r}; known: {', '.join(sorted(VALUE_TYPES))}"
        ) from None


def cast_value(value: Column, value_type: str, strict: bool = True) -> Column:
    """Cast to the declared type.

    Strict fails the job on a value that does not fit; lenient turns such a value into NULL. A date is
    text of an ISO date and stays text.
    """
    target = column_type(value_type)
    if value_type == DATE:
        text = value.cast("string")
        dated = F.when(text.rlike(_ISO_DATE) & text.try_cast("date").isNotNull(), text)
        if not strict:
            return dated
        wrong = F.raise_error(F.concat(F.lit("not an ISO date: "), text)).cast("string")
        return F.when(text.isNotNull(), F.coalesce(dated, wrong))
    return value.cast(target) if strict else value.try_cast(target)


def decode_label(value: Column, words: Mapping[str, str], default: str) -> Column:
    """Word for each listed label, ``default`` for everything else, NULL and empty text included."""
    chain = reduce(
        lambda acc, kv: acc.when(value == F.lit(kv[0]), F.lit(kv[1])),
        words.items(),
        F.when(F.lit(False), F.lit(default)),
    )
    return chain.otherwise(F.lit(default))


def lookup_code(value: Column, codes: Mapping[Any, Any]) -> Column:
    """Code for each listed category, NULL for any other."""
    return reduce(
        lambda acc, kv: acc.when(value == F.lit(kv[0]), F.lit(kv[1])),
        codes.items(),
        F.when(F.lit(False), F.lit(next(iter(codes.values())))),
    )


def check_day(dt: str) -> str:
    """Accept ``yyyy-MM-dd`` text only. The open-row sentinel has that shape and is never parsed."""
    if not _DAY.fullmatch(dt):
        raise ValueError(f"day must look like yyyy-MM-dd, got {dt!r}")
    return dt


def day_suffix(dt: str) -> str:
    """``yyyy-MM-dd`` as ``yyyyMMdd``, for per-day table names."""
    return check_day(dt).replace("-", "")
