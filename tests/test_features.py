import pytest
from frames import plan_of, rows

from tagloom.operators import features

LOG = "user_id bigint, page_id string, page_item string, page_item_type string, during_time bigint, dt string"
DAY = "2024-01-31"


def logs(spark, *visits, dt=DAY):
    """Visits as (user, item, seconds)."""
    data = [(u, "good_detail", str(i), "sku_id", d, dt) for u, i, d in visits]
    return spark.createDataFrame(data, LOG)


def items(spark, *pairs, dt=DAY):
    return spark.createDataFrame([(str(i), c, dt) for i, c in pairs], "id string, category1_id string, dt string")


def users(spark, *pairs):
    current = [(i, g, "9999-99-99") for i, g in pairs]
    return spark.createDataFrame(current + [(1, "old", "2020-01-01")], "id bigint, gender string, dt string")


def test_only_item_pages_of_the_day_count(spark):
    data = logs(spark, (1, 5, 10)).union(
        spark.createDataFrame(
            [
                (1, "home", "5", "sku_id", 1, DAY),
                (1, "good_detail", "5", "activity_id", 2, DAY),
                (1, "good_detail", "5", "sku_id", 4, "2024-01-30"),
                (1, "good_detail", "6", "sku_id", 8, DAY),
                (1, "good_detail", None, "sku_id", 16, DAY),
                (1, "good_detail", "abc", "sku_id", 32, DAY),
            ],
            LOG,
        )
    )
    old = items(spark, (5, "99"), dt="2024-01-30")
    out = features.item_visits(data, items(spark, (5, "3")).union(old), DAY)
    assert rows(out) == [(1, "3", 10)]


def test_day_range_is_closed(spark):
    data = logs(spark, (1, 5, 1), dt="2024-01-29").union(logs(spark, (1, 5, 2), dt="2024-01-30")).union(
        logs(spark, (1, 5, 4))
    )
    out = features.item_visits(data, items(spark, (5, "3")), "2024-01-30", DAY)
    assert sorted(r["during_time"] for r in out.collect()) == [2, 4]


def test_one_item_snapshot_is_used(spark):
    """Two snapshots of an item must not double its visits."""
    data = logs(spark, (1, 5, 1), dt="2024-01-29").union(logs(spark, (1, 5, 2)))
    two_days = items(spark, (5, "3")).union(items(spark, (5, "4"), dt="2024-01-30"))
    assert rows(features.item_visits(data, two_days, item_dt=DAY)) == [(1, "3", 1), (1, "3", 2)]
    with pytest.raises(ValueError, match="item_dt"):
        features.item_visits(data, two_days)


def test_item_ids_may_be_numbers(spark):
    numeric = spark.createDataFrame([(5, "3", DAY)], "id bigint, category1_id string, dt string")
    assert features.item_visits(logs(spark, (1, 5, 10)), numeric, DAY).count() == 1


def test_visits_and_ranks_with_ties(spark):
    data = logs(spark, (1, 1, 5), (1, 1, 5), (1, 2, 7), (1, 3, 9), (2, 2, 1))
    catalogue = items(spark, (1, "20"), (2, "10"), (3, "4"))
    visited = features.category_visits(features.item_visits(data, catalogue, DAY))
    assert rows(visited) == [(1, "10", 1, 7), (1, "20", 2, 10), (1, "4", 1, 9), (2, "10", 1, 1)]
    ranked = features.rank_categories(visited)
    # Category 4 before 10: ties are broken by the number, not by its text.
    assert rows(ranked) == [(1, 10, 1, 7, 3), (1, 20, 2, 10, 1), (1, 4, 1, 9, 2), (2, 10, 1, 1, 1)]


def test_profile_fills_missing_ranks_and_sums_all_categories(spark):
    ranked = spark.createDataFrame(
        [(1, 20, 9, 1, 1), (1, 21, 8, 1, 2), (1, 22, 7, 1, 3), (1, 3, 1, 50, 4), (1, 8, 1, 60, 5), (2, 6, 1, 70, 1)],
        "user_id bigint, c1 bigint, ct bigint, dur_time bigint, rk int",
    )
    out = features.category_profile(ranked)
    assert out.columns == ["user_id", "c1_rk1", "c1_rk2", "c1_rk3", "male_dur", "female_dur"]
    assert rows(out) == [(1, 20, 21, 22, 50, 60), (2, 6, 0, 0, 70, 0)]
    assert features.category_profile(ranked, k=1, sets={}).columns == ["user_id", "c1_rk1"]
    assert features.feature_columns() == out.columns[1:]


def test_null_category_counts_as_no_category(spark):
    data = logs(spark, (1, 1, 5), (1, 1, 5), (1, 2, 7))
    catalogue = items(spark, (1, None), (2, "3"))
    visits = features.item_visits(data, catalogue, DAY)
    out = features.category_profile(features.rank_categories(features.category_visits(visits)))
    assert rows(out) == [(1, 0, 3, 0, 7, 0)]


def test_three_kinds_of_missing_label(spark):
    people = users(spark, (1, "F"), (2, "x"), (3, ""), (4, None))

    def ids(df):
        return sorted(r["id"] for r in df.collect())

    assert ids(features.labelled_users(people)) == [1, 2]
    assert ids(features.unlabelled_users(people)) == [4]
    assert ids(features.declared_users(people)) == [1, 2, 3]
    assert ids(features.unlabelled_users(people, treat_empty_as_missing=True)) == [3, 4]
    assert ids(features.declared_users(people, treat_empty_as_missing=True)) == [1, 2]


def test_behaviour_features_join_labels(spark):
    data = logs(spark, (1, 1, 5), (2, 1, 6), (3, 1, 7), (4, 1, 8), (5, 1, 9))
    people = users(spark, (1, "F"), (2, "M"), (3, ""), (4, None))
    catalogue = items(spark, (1, "3"))
    train = features.behaviour_features(data, catalogue, people, DAY)
    assert train.columns == ["user_id", *features.feature_columns(), "gender"]
    assert rows(train) == [(1, 3, 0, 0, 5, 0, "F"), (2, 3, 0, 0, 6, 0, "M")]
    rest = features.behaviour_features(data, catalogue, people, DAY, labelled=False)
    assert rest.columns == ["user_id", *features.feature_columns()]
    assert rows(rest) == [(4, 3, 0, 0, 8, 0)]


def test_text_user_ids_in_the_user_table(spark):
    people = spark.createDataFrame([("1", "F", "9999-99-99"), ("x", "F", "9999-99-99")], "id string, gender string, dt string")
    out = features.behaviour_features(logs(spark, (1, 1, 5)), items(spark, (1, "3")), people, DAY)
    assert [r["user_id"] for r in out.collect()] == [1]


def test_plan_of_the_features(spark, tmp_path):
    """Filters reach the scan, the profile's partitioning serves the label join, nothing is crossed."""
    logs(spark, (1, 1, 5)).write.parquet(str(tmp_path / "logs"))
    items(spark, (1, "3")).write.parquet(str(tmp_path / "items"))
    users(spark, (1, "F")).write.parquet(str(tmp_path / "users"))
    read = [spark.read.parquet(str(tmp_path / n)) for n in ("logs", "items", "users")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(features.behaviour_features(*read, DAY))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "EqualTo(page_id,good_detail)" in plan
    # Both sides of the item join, visits by category, the profile by user, and the users.
    assert plan.count("Exchange hashpartitioning") == 5
    assert plan.count("SortMergeJoin") == 2
    assert "Python" not in plan and "Cartesian" not in plan and "Broadcast" not in plan


def test_category_codes(spark):
    data = [("1", "长发", 170.0, "是", "00后", "F"), ("2", "光头", 180.0, None, "60后", "M")]
    sample = spark.createDataFrame(data, "uid string, hair string, height double, skirt string, age string, gender string")
    assert rows(features.category_codes(sample)) == [("1", 101, 170.0, 11, 100, "F"), ("2", None, 180.0, None, None, "M")]


def test_one_hot_user_and_item(spark):
    """A user and an item with most of the visits."""
    from pyspark.sql import functions as F

    hot = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(0).alias("user_id"),
        F.lit("good_detail").alias("page_id"),
        F.lit("1").alias("page_item"),
        F.lit("sku_id").alias("page_item_type"),
        F.lit(2).cast("bigint").alias("during_time"),
        F.lit(DAY).alias("dt"),
    )
    visited = features.category_visits(features.item_visits(hot, items(spark, (1, "3")), DAY))
    assert visited.filter("user_id = 0").first()["ct"] == 20_001
    assert visited.count() == 10_000
    assert visited.agg(F.sum("dur_time")).first()[0] == 60_000


@pytest.mark.parametrize("bad", ["2024/01/31", "today"])
def test_days_are_checked(spark, bad):
    with pytest.raises(ValueError):
        features.item_visits(logs(spark), items(spark), bad)


def test_profile_in_one_aggregation_equals_the_ranked_one(spark):
    from workload import roles

    sf = "/root/testdata/sf0.01"
    visits = features.item_visits(roles.page_logs(spark, sf), roles.items(spark, sf), item_dt=roles.DAY, page_id=roles.VIEW_PAGE)
    visited = features.category_visits(visits).union(spark.createDataFrame([(5, None, 9, 1.0), (5, "x", 9, 2.0)], "a bigint, b string, c bigint, d double")
        .selectExpr("a", "case when b is null then b else '7' end", "c", "cast(d as decimal(26,2))"))
    for k, sets in ((3, features.DWELL_SETS), (5, {}), (0, features.DWELL_SETS), (1, {"s": (7,)})):
        plain = features.category_profile(features.rank_categories(visited), k, sets)
        one = features.visited_profile(visited, k, sets)
        assert one.columns == plain.columns and rows(one) == rows(plain)


def test_features_need_no_window(spark):
    from workload import queries

    plan = plan_of(queries.behaviour_features_train(spark, "/root/testdata/sf0.001"))
    assert "Window" not in plan and "Sort " not in plan
