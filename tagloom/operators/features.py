"""Behaviour features of users, and category codes of a sample table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.values import check_day, lookup_code
from tagloom.sources.tables import CURRENT_DAY

# The page and item kind that count as a visit, and the categories of each dwell sum.
VISIT_PAGE = "good_detail"
VISIT_ITEM_TYPE = "sku_id"
TOP_CATEGORIES = 3
DWELL_SETS = {
    "male": (3, 4, 6),
    "female": (8, 11, 15),
}

# Numeric codes of the sample table's categories.
SAMPLE_CODES = {
    "hair": {"长发": 101, "短发": 102, "板寸": 103},
    "skirt": {"是": 11, "否": 12},
    "age": {"00后": 100, "90后": 90, "80后": 80},
}


def item_visits(
    logs: DataFrame,
    items: DataFrame,
    dt_from: str | None = None,
    dt_to: str | None = None,
    item_dt: str | None = None,
    page_id: str = VISIT_PAGE,
    item_type: str = VISIT_ITEM_TYPE,
) -> DataFrame:
    """Item page views with the item's category: ``(user_id, category1_id, during_time)``.

    ``dt_from`` and ``dt_to`` bound the log days, both included; with ``dt_from`` alone it is that one
    day, and without either all days count. ``item_dt`` is the day of the one item snapshot to use, and
    is the last log day unless given.
    """
    dt_to = dt_to or dt_from
    item_dt = item_dt or dt_to
    if not item_dt:
        raise ValueError("item_dt is needed when the log days have no end")
    views = logs.filter((F.col("page_id") == page_id) & (F.col("page_item_type") == item_type))
    if dt_from:
        views = views.filter(F.col("dt") >= check_day(dt_from))
    if dt_to:
        views = views.filter(F.col("dt") <= check_day(dt_to))
    items = items.filter(F.col("dt") == check_day(item_dt))
    views = views.select("user_id", F.col("page_item").cast("string").alias("_item"), "during_time")
    snapshot = items.select(F.col("id").cast("string").alias("_item"), "category1_id")
    # No broadcast hint: the two-column snapshot is broadcast while Spark's statistics say it is small,
    # and beyond that adaptive execution splits the partitions of hot items.
    return views.join(snapshot, "_item").select("user_id", "category1_id", "during_time")


def category_visits(visits: DataFrame) -> DataFrame:
    """Visits and dwell of each user and category: ``(user_id, category1_id, ct, dur_time)``."""
    return visits.groupBy("user_id", "category1_id").agg(
        F.count("*").alias("ct"), F.sum("during_time").alias("dur_time")
    )


def rank_categories(visited: DataFrame) -> DataFrame:
    """Rank of each category for its user, most visits first: ``(user_id, c1, ct, dur_time, rk)``.

    Equal counts are ordered by category, so the result does not depend on the run. A user has at most
    one row per category here, which bounds the window.
    """
    ranked = visited.select("user_id", F.col("category1_id").cast("bigint").alias("c1"), "ct", "dur_time")
    order = Window.partitionBy("user_id").orderBy(F.desc("ct"), F.asc("c1"))
    return ranked.withColumn("rk", F.row_number().over(order))


def category_profile(
    ranked: DataFrame,
    k: int = TOP_CATEGORIES,
    sets: Mapping[str, Sequence[int]] = DWELL_SETS,
) -> DataFrame:
    """Top categories and dwell by category set: ``(user_id, c1_rk1..k, <set>_dur...)``.

    A rank the user does not reach is 0. Dwell sums run over all categories, not only the top ones.
    """
    c1, dur = F.col("c1"), F.col("dur_time")
    tops = [
        F.sum(F.when(F.col("rk") == r, c1).otherwise(0)).alias(f"c1_rk{r}") for r in range(1, k + 1)
    ]
    dwell = [
        F.sum(F.when(c1.isin(list(members)), dur).otherwise(0)).alias(f"{name}_dur")
        for name, members in sets.items()
    ]
    return ranked.groupBy("user_id").agg(*tops, *dwell)


def visited_profile(
    visited: DataFrame,
    k: int = TOP_CATEGORIES,
    sets: Mapping[str, Sequence[int]] = DWELL_SETS,
) -> DataFrame:
    """``category_profile`` of ``rank_categories`` in one aggregation, without a window or a sort of all rows.

    A user's categories and counts are put together in the aggregate that also sums the dwell sets, and the first
    ``k`` are read off it. What a user holds there is bounded by the number of categories, as a category is one row.
    """
    c1, dur = F.col("c1"), F.col("dur_time")
    rows = visited.select("user_id", F.col("category1_id").cast("bigint").alias("c1"), "ct", "dur_time")
    dwell = [
        F.sum(F.when(c1.isin(list(members)), dur).otherwise(0)).alias(f"{name}_dur")
        for name, members in sets.items()
    ]
    # Most visits first, and among equal counts the lowest category; a category without a number is the lowest.
    order = F.struct((-F.col("ct")).alias("less"), "c1")
    users = rows.groupBy("user_id").agg(F.collect_list(order).alias("_order"), *dwell)
    first = F.slice(F.sort_array("_order"), 1, max(k, 1))
    users = users.withColumn("_order", first)
    tops = [F.coalesce(F.get("_order", F.lit(r - 1))["c1"], F.lit(0)).alias(f"c1_rk{r}") for r in range(1, k + 1)]
    return users.select("user_id", *tops, *(f"{name}_dur" for name in sets))


def labelled_users(users: DataFrame, label: str = "gender") -> DataFrame:
    """Current users whose label is present: neither NULL nor empty."""
    return _current(users).filter(F.col(label) != "").select("id", label)


def unlabelled_users(
    users: DataFrame, label: str = "gender", treat_empty_as_missing: bool = False
) -> DataFrame:
    """Current users whose label is NULL; an empty label counts as missing only on request."""
    missing = F.col(label).isNull()
    if treat_empty_as_missing:
        missing = missing | (F.col(label) == "")
    return _current(users).filter(missing).select("id", label)


def declared_users(
    users: DataFrame, label: str = "gender", treat_empty_as_missing: bool = False
) -> DataFrame:
    """Current users who gave a label themselves; an empty label counts as given unless told otherwise."""
    given = F.col(label) != "" if treat_empty_as_missing else F.col(label).isNotNull()
    return _current(users).filter(given).select("id", label)


def _current(users: DataFrame) -> DataFrame:
    return users.filter(F.col("dt") == CURRENT_DAY)


def behaviour_features(
    logs: DataFrame,
    items: DataFrame,
    users: DataFrame,
    dt_from: str | None = None,
    dt_to: str | None = None,
    labelled: bool = True,
    k: int = TOP_CATEGORIES,
    sets: Mapping[str, Sequence[int]] = DWELL_SETS,
    label: str = "gender",
    treat_empty_as_missing: bool = False,
    item_dt: str | None = None,
    page_id: str = VISIT_PAGE,
    item_type: str = VISIT_ITEM_TYPE,
) -> DataFrame:
    """Features of the users with (or without) a label: ``(user_id, c1_rk1..k, <set>_dur..., [label])``."""
    profile = behaviour_profile(logs, items, dt_from, dt_to, k, sets, item_dt, page_id, item_type)
    return profile_of_users(profile, users, labelled, label, treat_empty_as_missing)


def behaviour_profile(
    logs: DataFrame,
    items: DataFrame,
    dt_from: str | None = None,
    dt_to: str | None = None,
    k: int = TOP_CATEGORIES,
    sets: Mapping[str, Sequence[int]] = DWELL_SETS,
    item_dt: str | None = None,
    page_id: str = VISIT_PAGE,
    item_type: str = VISIT_ITEM_TYPE,
) -> DataFrame:
    """The features of all users with visits, whatever their label: ``(user_id, c1_rk1..k, <set>_dur...)``.

    Training and prediction on the same days differ in the users only, so they can share a stored profile.
    """
    visits = item_visits(logs, items, dt_from, dt_to, item_dt, page_id, item_type)
    return visited_profile(category_visits(visits), k, sets)


def profile_of_users(
    profile: DataFrame,
    users: DataFrame,
    labelled: bool = True,
    label: str = "gender",
    treat_empty_as_missing: bool = False,
) -> DataFrame:
    """The rows of a profile for the users with (or without) a label."""
    wanted = (
        labelled_users(users, label)
        if labelled
        else unlabelled_users(users, label, treat_empty_as_missing)
    )
    # The id takes the type of user_id, so the profile keeps its partitioning for this join.
    key_type = profile.schema["user_id"].dataType
    side = wanted.select(F.col("id").try_cast(key_type).alias("user_id"), label)
    joined = profile.join(side, "user_id")
    return joined if labelled else joined.drop(label)


def feature_columns(k: int = TOP_CATEGORIES, sets: Mapping[str, Sequence[int]] = DWELL_SETS) -> list[str]:
    return [f"c1_rk{r}" for r in range(1, k + 1)] + [f"{name}_dur" for name in sets]


def category_codes(df: DataFrame, codes: Mapping[str, Mapping[Any, Any]] = SAMPLE_CODES) -> DataFrame:
    """Replace the named category columns by their codes; a category without a code becomes NULL."""
    return df.withColumns({name: lookup_code(F.col(name), table) for name, table in codes.items()})
