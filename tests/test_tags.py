from decimal import Decimal

import pytest
from frames import rows
from pyspark.sql import functions as F

from tagloom.operators import tags
from tagloom.operators.tags import compute_tag, map_rules, task_query

RULES = "id bigint, query_value string, sub_tag_value string"


def source(spark, values, kind="string"):
    data = [(str(i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, f"uid string, query_value {kind}")


def values(df):
    return [r["tag_value"] for r in df.orderBy("uid").collect()]


class TestRules:
    def test_unmatched_and_null_become_null(self, spark):
        rules = spark.createDataFrame([(1, "F", "female")], RULES)
        out = map_rules(source(spark, ["F", "M", None]), rules)
        assert values(out) == ["female", None, None]

    def test_lowest_rule_id_wins(self, spark):
        rules = spark.createDataFrame([(2, "F", "late"), (1, "F", "early")], RULES)
        assert values(map_rules(source(spark, ["F"]), rules)) == ["early"]

    def test_quotes_in_keys_and_values(self, spark):
        rules = spark.createDataFrame([(1, "it's", "driver's")], RULES)
        assert values(map_rules(source(spark, ["it's", "its"]), rules)) == ["driver's", None]

    def test_numbers_compare_as_text(self, spark):
        rules = spark.createDataFrame([(1, "abc", "text"), (2, "7", "seven")], RULES)
        assert values(map_rules(source(spark, [7, 8], "bigint"), rules)) == ["seven", None]

    def test_rule_with_null_key_never_matches(self, spark):
        rules = spark.createDataFrame([(1, None, "none"), (2, "a", "A")], RULES)
        assert values(map_rules(source(spark, [None, "a"]), rules)) == [None, "A"]

    def test_repeated_rows_stay(self, spark):
        rules = spark.createDataFrame([(1, "a", "A")], RULES)
        src = source(spark, ["a", "a", "a"]).unionByName(source(spark, ["a"]))
        assert values(map_rules(src, rules)) == ["A"] * 4


def test_without_rules_the_value_stays(spark):
    none = spark.createDataFrame([], RULES)
    assert values(compute_tag(source(spark, ["5", "6"]), none, "1")) == [5, 6]
    assert values(compute_tag(source(spark, ["5", "6"]), None, "3")) == ["5", "6"]


def test_types_of_the_tag_table(spark):
    kinds = {"1": "bigint", "2": "decimal(16,2)", "3": "string", "4": "string"}
    for value_type, kind in kinds.items():
        out = compute_tag(source(spark, ["1"]), None, value_type)
        assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [
            ("uid", "string"),
            ("tag_value", kind),
        ]
    with pytest.raises(ValueError, match="value type"):
        compute_tag(source(spark, ["1"]), None, "5")


def test_strict_cast_fails_and_lenient_gives_null(spark):
    src = source(spark, ["12", "x", None])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        compute_tag(src, None, "1").collect()
    assert values(compute_tag(src, None, "1", strict=False)) == [12, None, None]


def test_decimals_round_and_overflow(spark):
    src = source(spark, ["1.005", "2.5", "123456789012345678"])
    assert values(compute_tag(src, None, "2", strict=False)) == [Decimal("1.01"), Decimal("2.50"), None]
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE|CAST_INVALID_INPUT"):
        compute_tag(src, None, "2").collect()


def test_dates_stay_text(spark):
    src = source(spark, ["2024-02-29", "2023-02-29", "20240101", "9999-99-99"])
    assert values(compute_tag(src.limit(1), None, "4")) == ["2024-02-29"]
    for wrong in ("2023-02-29", "20240101", "9999-99-99", "not a date"):
        with pytest.raises(Exception, match="not an ISO date"):
            compute_tag(source(spark, ["2024-02-29", wrong]), None, "4").collect()
    assert values(compute_tag(src, None, "4", strict=False)) == ["2024-02-29", None, None, None]


def test_day_is_put_into_the_query(spark):
    out = task_query(spark, "select 1 as uid, '$dt' as query_value where '$dt' > '2000-01-01'", "2024-01-31")
    assert rows(out) == [(1, "2024-01-31")]


def test_query_may_be_a_function(spark):
    out = task_query(spark, lambda s, dt: s.sql(f"select '{dt}' as query_value, 'u' as uid, 1 as extra"), "2024-01-31")
    assert rows(out) == [("u", "2024-01-31")]


def test_query_needs_its_two_columns(spark):
    with pytest.raises(ValueError, match="query_value"):
        task_query(spark, "select 1 as uid, 2 as value", "2024-01-31")


def test_day_must_be_a_day(spark):
    with pytest.raises(ValueError, match="yyyy-MM-dd"):
        task_query(spark, "select 1 as uid, 2 as query_value", "2024-1-31' or '1'='1")


def test_rules_have_one_form_for_every_number(spark):
    src = source(spark, ["k", "z", None])
    few = [(None, "k", "nobody's"), (5, "k", "five"), (7, "k", "seven"), (1, None, "null")]
    many = few + [(100 + i, f"other{i}", "x") for i in range(300)]
    for rules in (few, many):
        df = spark.createDataFrame(rules, "id long, query_value string, sub_tag_value string")
        assert sorted(values(compute_tag(src, df, "3")), key=str) == [None, None, "five"]
    none = spark.createDataFrame([], "id long, query_value string, sub_tag_value string")
    assert values(compute_tag(src, none, "3")) == ["k", "z", None]


def test_rows_without_a_uid(spark):
    src = spark.createDataFrame([("1", "a"), (None, "b")], "uid string, query_value string")
    with pytest.raises(Exception, match="without uid"):
        compute_tag(src, None, "3").collect()
    assert rows(compute_tag(src, None, "3", strict=False)) == [("1", "a")]


def test_shared_tags_equal_their_own_queries(spark):
    """Several tags from one aggregation: the rows of each tag's own query, NULL values and rules included."""
    from tagloom.operators.merge import tall_table

    people = [(1, "F", 10.5), (1, "F", 2.0), (2, "M", None), (3, "x", 7.25), (4, None, 1.0)]
    spark.createDataFrame(people, "id bigint, sex string, paid double").createOrReplaceTempView("shared_people")
    rules = spark.createDataFrame([(1, "F", "female"), (2, "M", "male")], "id bigint, query_value string, sub_tag_value string")
    kinds = {"TG_N": ("1", None, "count(*)"), "TG_Paid": ("2", None, "sum(paid)"), "TG_Sex": ("3", rules, "max(sex)")}
    own = {
        code: tags.compute_tag(
            tags.task_query(spark, f"select id as uid, {sql} as query_value from shared_people group by id", "2024-01-31"), r, kind
        )
        for code, (kind, r, sql) in kinds.items()
    }
    columns = ", ".join(f"{sql} as {code}" for code, (_, _, sql) in kinds.items())
    src = tags.shared_query(spark, f"select id as uid, {columns} from shared_people group by id", "2024-01-31", list(kinds))
    shared = [tags.SharedTag(code, kind, r) for code, (kind, r, _) in kinds.items()]
    assert rows(tags.shared_tall(src, shared)) == rows(tall_table(own))
    grouped = tags.grouped_source(
        spark.table("shared_people"), "id", {"TG_N": F.count("*"), "TG_Paid": F.sum("paid"), "TG_Sex": F.max("sex")}
    )
    assert rows(tags.shared_tall(grouped, shared)) == rows(tall_table(own))
    with pytest.raises(ValueError, match="tg_other"):
        tags.shared_query(spark, "select 1 as uid", "2024-01-31", ["TG_Other"])


def test_shared_tags_scan_their_source_once(spark):
    from workload import tagset

    plan = tagset.tall(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    # Orders: counts, amounts and last orders together, then statuses and quantities; customers: two tags, and nations.
    assert sum("o_custkey" in s for s in scans) == 3 and sum("c_custkey" in s for s in scans) == 2
