from decimal import Decimal

import pytest
from frames import plan_of, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tagloom.operators.bitmaps import unpivot_tags
from tagloom.operators.merge import duplicate_users, tall_table, wide_table

SCHEMA = "uid string, tag_value string, tag_code string"


def tall(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def test_mixed_types_become_text(spark):
    frames = {
        "TG_L": spark.sql("select 'a' as uid, 7L as tag_value"),
        "TG_D": spark.sql("select 'a' as uid, cast(1.5 as decimal(16,2)) as tag_value"),
        "TG_S": spark.sql("select 'b' as uid, 'text' as tag_value"),
        "TG_T": spark.sql("select 'b' as uid, '2024-01-31' as tag_value"),
    }
    out = tall_table(frames)
    assert rows(out) == [
        ("a", "1.50", "tg_d"),
        ("a", "7", "tg_l"),
        ("b", "2024-01-31", "tg_t"),
        ("b", "text", "tg_s"),
    ]


@pytest.mark.parametrize("once", [False, True, ["G"]])
def test_missing_and_null_cells_are_empty_text(spark, once):
    out = wide_table(tall(spark, ("1", "f", "g"), ("2", None, "g"), ("3", "x", "h"), ("4", "", "h")), ["G", "H"], once)
    assert out.columns == ["uid", "g", "h"]
    assert rows(out) == [("1", "f", ""), ("2", "", ""), ("3", "", "x"), ("4", "", "")]


@pytest.mark.parametrize("once", [False, ["g"]])
def test_repeated_users_join_their_values_in_order(spark, once):
    data = [("1", "c", "h"), ("1", "a", "h"), ("1", "a", "h"), ("1", None, "h"), ("1", "", "h"), ("1", "z", "g")]
    assert rows(wide_table(tall(spark, *data), ["g", "h"], once)) == [("1", "z", "aac")]


@pytest.mark.parametrize("policy", ["EXCEPTION", "LAST_WIN"])
def test_a_broken_one_value_promise_fails(spark, policy):
    twice = tall(spark, ("1", "a", "g"), ("1", "b", "g"))
    spark.conf.set("spark.sql.mapKeyDedupPolicy", policy)
    try:
        with pytest.raises(Exception, match="more than once"):
            wide_table(twice, ["g"], one_value=True).collect()
    finally:
        spark.conf.unset("spark.sql.mapKeyDedupPolicy")


def test_tags_outside_the_catalogue_make_no_column(spark):
    out = wide_table(tall(spark, ("1", "a", "g"), ("2", "b", "other")), ["g"])
    assert rows(out) == [("1", "a"), ("2", "")]


def test_a_user_with_most_rows(spark):
    """One user holds nearly all rows; the counted values are what reaches its task."""
    from pyspark.sql import functions as F

    hot = spark.range(50_000).select(
        F.lit("hot").alias("uid"), (F.col("id") % 3).cast("string").alias("tag_value"), F.lit("g").alias("tag_code")
    )
    out = wide_table(hot.unionByName(tall(spark, ("cold", "x", "g"))), ["g"])
    cells = dict(rows(out))
    assert cells["cold"] == "x"
    assert cells["hot"] == "0" * 16667 + "1" * 16667 + "2" * 16666


def test_empty_and_colliding_catalogues_are_refused(spark):
    with pytest.raises(ValueError, match="no tag"):
        tall_table({})
    with pytest.raises(ValueError, match="no tag"):
        wide_table(tall(spark, ("1", "a", "g")), [])
    with pytest.raises(ValueError, match="case"):
        wide_table(tall(spark, ("1", "a", "g")), ["g", "G"])


def test_duplicate_users(spark):
    data = [("1", "a", "g"), ("1", "a", "g"), ("1", "b", "h"), ("2", "a", "g")]
    assert rows(duplicate_users(tall(spark, *data))) == [("1", "g", 2)]


def test_many_tags_in_one_plan(spark):
    frames = {
        f"T{i}": spark.range(3).selectExpr("cast(id as string) as uid", f"id * {i} as tag_value") for i in range(60)
    }
    out = wide_table(tall_table(frames), list(frames), one_value=True)
    assert len(out.columns) == 61
    assert out.filter("uid = '2'").first()["t59"] == "118"


def test_shuffles(spark, tmp_path):
    """One shuffle by user; rows of tags that may repeat are counted before it."""
    path = str(tmp_path / "tall")
    tall(spark, ("1", "a", "g"), ("1", "b", "h")).write.parquet(path)
    stored = spark.read.parquet(path)
    for promise, shuffles in ((True, 1), (False, 2), (["g"], 2)):
        plan = plan_of(wide_table(stored, ["g", "h"], one_value=promise))
        assert plan.count("Exchange hashpartitioning") == shuffles
        assert plan.count("partial_count") == shuffles - 1
        assert "Cartesian" not in plan and "Python" not in plan


def test_a_hot_user_leaves_a_map_task_as_one_row_for_each_value(spark, tmp_path):
    """A user with a third of all rows: what is shuffled is counted, in rows, from the metrics of the exchanges."""
    from pyspark.sql import functions as F

    path = str(tmp_path / "tall")
    hot = spark.range(30_000).select(
        F.lit("hot").alias("uid"), (F.col("id") % 7).cast("string").alias("tag_value"), F.lit("h").alias("tag_code")
    )
    cold = spark.range(60_000).select(
        F.col("id").cast("string").alias("uid"), F.lit("x").alias("tag_value"), F.lit("g").alias("tag_code")
    )
    hot.union(cold).repartition(4).write.parquet(path)
    out = wide_table(spark.read.parquet(path), ["g", "h"], one_value=["g"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = wide_table(spark.read.parquet(path), ["g", "h"], one_value=["g"])
        cells = {r.uid: r.h for r in out.filter("uid in ('hot', '5')").collect()}
        whole = wide_table(spark.read.parquet(path), ["g", "h"], one_value=["g"])
        assert len(whole.collect()) == 60_001
        written, todo = [], [whole._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if node.nodeName() == "Exchange":
                written.append(node.metrics().apply("shuffleRecordsWritten").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    size = 30_000
    assert cells["hot"] == "".join(str(v) * (size // 7 + (v < size % 7)) for v in range(7)) and cells["5"] == ""
    # By user: all cold rows and seven counted rows. Before that: seven rows from each of the map tasks.
    assert sorted(written)[1] == 60_007 and sorted(written)[0] <= 7 * 8


def test_rows_of_repeated_tags_may_come_apart(spark):
    once = tall(spark, ("1", "a", "g"), ("2", "b", "g"))
    often = tall(spark, ("1", "y", "h"), ("1", "x", "h"), ("1", "x", "h"), ("3", None, "h"))
    out = wide_table(once, ["g", "h"], ["g"], often)
    assert rows(out) == [("1", "a", "xxy"), ("2", "b", ""), ("3", "", "")]
    with pytest.raises(Exception, match="more than once"):
        wide_table(once.union(once), ["g", "h"], ["g"], often).collect()


def test_one_value_prunes_whole_branches(spark, tmp_path):
    frames = {}
    for code in ("a", "b", "c"):
        spark.sql("select '1' as uid, '2' as tag_value").write.parquet(str(tmp_path / code))
        frames[code] = spark.read.parquet(str(tmp_path / code))
    plan = plan_of(wide_table(tall_table(frames), list(frames), one_value=["a", "b"]))
    assert plan.count("FileScan") == 3


CELL = st.one_of(st.none(), st.sampled_from(["", "a", "b", "ab"]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("123"), CELL, st.sampled_from(["g", "h"])), min_size=1, max_size=12))
def test_unpivot_of_pivot_keeps_the_joined_cells(spark, data):
    wide = wide_table(tall(spark, *data), ["g", "h"])
    want = {}
    for uid, value, code in data:
        want.setdefault((uid, code), []).append(value or "")
    cells = {k: "".join(sorted(v)) for k, v in want.items()}
    assert rows(unpivot_tags(wide, ["g", "h"])) == sorted((u, c, v) for (u, c), v in cells.items() if v)
    assert {r[0] for r in rows(wide)} == {d[0] for d in data}


def test_decimal_text_keeps_scale(spark):
    frame = spark.createDataFrame([("1", Decimal("0.00")), ("2", Decimal("-3.10"))], "uid string, tag_value decimal(16,2)")
    assert rows(wide_table(tall_table({"A": frame}), ["A"])) == [("1", "0.00"), ("2", "-3.10")]


def test_many_tags_lie_in_several_maps(spark):
    codes = [f"tag_{i}" for i in range(300)]
    data = [(str(u), str(i * u), c) for u in (1, 2) for i, c in enumerate(codes) if (i + u) % 3]
    got = {r.uid: r.asDict() for r in wide_table(tall(spark, *data, ("2", "z", "tag_7")), codes, one_value=codes[:5]).collect()}
    for u in (1, 2):
        want = {c: str(i * u) if (i + u) % 3 else "" for i, c in enumerate(codes)}
        if u == 2:
            want["tag_7"] = "".join(sorted([want["tag_7"], "z"]))
        assert got[str(u)] == {"uid": str(u), **want}
