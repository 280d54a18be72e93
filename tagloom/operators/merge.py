"""Many tag tables to one row per user."""

from __future__ import annotations

import zlib
from collections.abc import Collection, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Tags whose cells share one of a user's maps, about: a lookup passes through its map.
MAP_CODES = 64


def tall_table(tags: Mapping[str, DataFrame], shared: Sequence[DataFrame] = ()) -> DataFrame:
    """Union of tag frames as ``(uid, tag_value, tag_code)``; all values become text first.

    ``shared`` are frames that have this form already, of tags that share their source.
    """
    branches = [
        df.select(
            "uid",
            F.col("tag_value").cast("string").alias("tag_value"),
            F.lit(code.lower()).alias("tag_code"),
        )
        for code, df in tags.items()
    ]
    branches += [df.select("uid", "tag_value", "tag_code") for df in shared]
    if not branches:
        raise ValueError("no tag to merge")
    # Pairwise, so that planning hundreds of tags does not revisit a growing plan for each of them.
    while len(branches) > 1:
        pairs = [branches[i : i + 2] for i in range(0, len(branches), 2)]
        branches = [reduce(DataFrame.union, pair) for pair in pairs]
    return branches[0]


def wide_table(
    tall: DataFrame,
    codes: Sequence[str],
    one_value: bool | Collection[str] = False,
    repeated: DataFrame | None = None,
) -> DataFrame:
    """One row per user, one text column per tag; a user without a value has ``''``.

    Values of a user that has a tag more than once are put one after the other in sorted order.

    ``one_value`` names the tags that a user has at most once, for example because their query groups
    by user; True means all of them. A tag that breaks this promise fails the job instead of losing a value. Rows
    of these tags cross the network once, to their user, where cells are put together in the row. Rows of the other
    tags are counted by user and value first: a user who holds a large share of all rows leaves a map task as one
    row for each distinct value. ``repeated`` gives their rows apart from ``tall``, so that neither is read twice.
    """
    columns = [c.lower() for c in codes]
    if not columns:
        raise ValueError("no tag to merge")
    if len(set(columns)) < len(columns):
        raise ValueError("tag codes must differ without case")
    single = set(columns) if one_value is True else {c.lower() for c in one_value or ()}
    # Empty text adds nothing to a cell; as NULL it falls together with the missing values.
    value = F.nullif(F.col("tag_value"), F.lit(""))
    parts = -(-len(columns) // MAP_CODES)
    part = F.crc32(F.col("tag_code").cast("binary")) % parts if parts > 1 else F.lit(0).cast("bigint")

    def entries_of(rows: DataFrame, times: Column) -> DataFrame:
        entry = F.struct(part.alias("part"), "tag_code", F.col("_cell").alias("cell"), times.alias("times"))
        return rows.select("uid", F.when(F.col("_cell").isNotNull(), entry).alias("entry"))

    def counted(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy("uid", "tag_code", value.alias("_cell")).agg(F.count("*").cast("int").alias("_times"))
        return entries_of(sums, F.col("_times"))

    once = F.lit(1)
    if one_value is True and repeated is None:
        rows = entries_of(tall.withColumn("_cell", value), once)
    elif repeated is not None:
        rows = entries_of(tall.withColumn("_cell", value), once).union(counted(repeated))
    elif not single:
        rows = counted(tall)
    else:
        kept = F.col("tag_code").isin(sorted(single))
        rows = entries_of(tall.filter(kept).withColumn("_cell", value), once).union(counted(tall.filter(~kept)))
    entries = rows.repartition("uid").groupBy("uid").agg(F.collect_list("entry").alias("entries"))
    # A lookup per column in a small map: a pivot evaluates every column for every tall row.
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))
    maps = F.transform(every, lambda p: _cell_map(F.filter("entries", lambda e: e["part"] == p), single))
    users = entries.select("uid", (maps if parts > 1 else F.array(_cell_map(F.col("entries"), single))).alias("maps"))
    cells = [f"coalesce(maps[{zlib.crc32(c.encode()) % parts}]['{c}'], '') AS `{c}`" for c in columns]
    return users.selectExpr("uid", *cells)


def _cell_map(entries: Column, single: set[str]) -> Column:
    """Cells by tag code. Only a user that has some tag twice pays for putting values together."""
    plain = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["tag_code"], e["cell"])))
    codes = entries["tag_code"]
    own = F.array_distinct(codes)

    def joined(code: Column) -> Column:
        mine = F.filter(entries, lambda e: e["tag_code"] == code)
        ordered = F.array_sort(F.transform(mine, lambda e: F.struct(e["cell"].alias("cell"), e["times"].alias("times"))))
        return F.struct(code, F.array_join(F.transform(ordered, lambda e: F.repeat(e["cell"], e["times"])), ""))

    repeated = F.map_from_entries(F.transform(own, joined))
    if single:
        promised = F.filter(codes, lambda c: c.isin(sorted(single)))
        kept = F.size(F.array_distinct(promised)) == F.size(promised)
        broken = F.raise_error(F.lit("a user has a tag of one_value more than once")).cast("map<string,string>")
        repeated = F.when(kept, repeated).otherwise(broken)
    each_once = (F.size(own) == F.size(codes)) & F.forall(entries, lambda e: e["times"] == 1)
    return F.when(each_once, plain).otherwise(repeated)


def duplicate_users(tall: DataFrame) -> DataFrame:
    """Users that have a tag more than once: ``(uid, tag_code, n)``. Empty when ``one_value`` holds."""
    counted = tall.groupBy("uid", "tag_code").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") > 1)
