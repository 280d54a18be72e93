"""One tag: source query, value rules, typed value."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.values import cast_value, check_day

TaskSource = str | Callable[[SparkSession, str], DataFrame]


def task_query(spark: SparkSession, source: TaskSource, dt: str) -> DataFrame:
    """Run a tag's source query for one day.

    The source is SQL text in which ``$dt`` stands for the day, or a function of session and day. It
    must yield ``uid`` and ``query_value``.
    """
    return _run(spark, source, dt, ["uid", "query_value"])


def shared_query(spark: SparkSession, source: TaskSource, dt: str, codes: Sequence[str]) -> DataFrame:
    """Run one source query that several tags share: it yields ``uid`` and a column for each tag code.

    Tags that are grouped from the same rows are then one scan and one aggregation, whatever their number.
    """
    return _run(spark, source, dt, ["uid", *(c.lower() for c in codes)])


def _run(spark: SparkSession, source: TaskSource, dt: str, columns: Sequence[str]) -> DataFrame:
    check_day(dt)
    df = source(spark, dt) if callable(source) else spark.sql(source.replace("$dt", dt))
    missing = set(columns) - {c.lower() for c in df.columns}
    if missing:
        raise ValueError(f"a tag query must yield {', '.join(columns)}; missing {sorted(missing)}")
    return df.select(*(F.col(f"`{c}`").alias(c) for c in columns))


def map_rules(src: DataFrame, rules: DataFrame | None) -> DataFrame:
    """Replace ``query_value`` by the value its rule maps to, as ``tag_value``.

    Keys compare as text and the lowest rule id wins between equal keys, a rule without an id last. A value
    without a rule, NULL included, becomes NULL. A tag without any rule keeps its value.
    """
    if rules is None or rules.isEmpty():
        return src.select("uid", F.col("query_value").alias("tag_value"))
    order = F.struct(F.col("id").isNull(), "id", "sub_tag_value")
    first = rules.groupBy(F.col("query_value").alias("_key")).agg(F.min_by("sub_tag_value", order).alias("tag_value"))
    # Unhinted on purpose: Spark broadcasts the rules while they are small by its own statistics and
    # splits a hot key of the sort-merge join beyond that.
    keyed = src.withColumn("_key", F.col("query_value").cast("string"))
    return keyed.join(first, "_key", "left").select("uid", "tag_value")


def compute_tag(
    src: DataFrame, rules: DataFrame | None, value_type: str, strict: bool = True
) -> DataFrame:
    """``(uid, query_value)`` to ``(uid string, tag_value)`` with the declared type.

    A row without a uid belongs to nobody: strict fails on it, lenient leaves it out.
    """
    src, uid = _somebody(src, strict)
    mapped = map_rules(src, rules)
    return mapped.select(uid.alias("uid"), cast_value(F.col("tag_value"), value_type, strict).alias("tag_value"))


def _somebody(src: DataFrame, strict: bool) -> tuple[DataFrame, Column]:
    if not strict:
        return src.filter(F.col("uid").isNotNull()), F.col("uid").cast("string")
    nobody = F.raise_error(F.lit("a tag query yields a row without uid")).cast("string")
    return src, F.coalesce(F.col("uid").cast("string"), nobody)


@dataclass(frozen=True)
class SharedTag:
    """One of several tags of a shared source: its code, value type and rules, if it has any."""

    code: str
    value_type: str
    rules: DataFrame | None = None


def typed_columns(src: DataFrame, tags: Sequence[SharedTag], strict: bool = True) -> DataFrame:
    """``uid`` and a typed column for each tag, from a shared query. Rules are joined one after the other."""
    src, uid = _somebody(src, strict)
    for tag in tags:
        if tag.rules is not None:
            name = tag.code.lower()
            rest = [c for c in src.columns if c != name]
            kept = src.select(F.struct(*rest).alias("uid"), F.col(f"`{name}`").alias("query_value"))
            src = map_rules(kept, tag.rules).select("uid.*", F.col("tag_value").alias(name))
    values = [cast_value(F.col(f"`{t.code.lower()}`"), t.value_type, strict).alias(t.code.lower()) for t in tags]
    return src.select(uid.alias("uid"), *values)


def shared_tall(src: DataFrame, tags: Sequence[SharedTag], strict: bool = True) -> DataFrame:
    """Several tags of one source as ``(uid, tag_value, tag_code)`` rows, values as text, in one pass.

    The rows are those that each tag alone would yield from a query with the same rows; a NULL value is a row too.
    """
    typed = typed_columns(src, tags, strict)
    cells = F.array(
        *(
            F.struct(F.col(f"`{t.code.lower()}`").cast("string").alias("tag_value"), F.lit(t.code.lower()).alias("tag_code"))
            for t in tags
        )
    )
    return typed.select("uid", F.inline(cells))


def grouped_source(rows: DataFrame, uid: str, values: Mapping[str, Column]) -> DataFrame:
    """A shared source from rows: one aggregation by user that yields an aggregate for each tag code."""
    return rows.groupBy(F.col(uid).alias("uid")).agg(*(value.alias(code.lower()) for code, value in values.items()))
