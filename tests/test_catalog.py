import pytest
from frames import rows

from tagloom.sources import catalog


@pytest.fixture(scope="module")
def meta(spark):
    def tag(id, code, name, level, kind, task, parent=0):
        return (id, code, name, level, parent, "1", kind, None, None, task, None, None, None)

    def task(id, status, sql="select 1 as uid, 2 as query_value"):
        return (id, f"task{id}", status, None, None, None, None, None, None, None, sql, None, None)

    tags = [
        tag(1, "TG_A", "a", 3, "1", 10),
        tag(2, "TG_B", "b", 3, "3", 11),
        tag(3, "TG_C", "c", 2, "3", 10),
        tag(4, "TG_D", "d", 3, "3", 99),
        tag(5, "TG_E", "e", 3, "3", None),
        tag(20, "B_F", "female", 4, "3", None, parent=2),
        tag(21, "B_M", "male", 4, "3", None, parent=2),
    ]
    rule_rows = [(7, 2, 11, "F", 20), (6, 2, 11, "M", 21), (8, 2, 11, "X", 404), (9, 1, 10, "F", 20)]
    return catalog.Metadata(
        spark.createDataFrame(tags, catalog.TAG_SCHEMA),
        spark.createDataFrame([task(10, "1"), task(11, "1"), task(12, "0")], catalog.TASK_SCHEMA),
        spark.createDataFrame(rule_rows, catalog.RULE_SCHEMA),
    )


def test_active_tags_need_level_and_running_task(meta):
    active = catalog.active_tags(meta.tag_info, meta.task_info)
    assert active.columns == meta.tag_info.columns
    assert [r["tag_code"] for r in active.orderBy("id").collect()] == ["TG_A", "TG_B"]


def test_specs_keep_case_and_name_lower_case_columns(meta):
    specs = catalog.tag_specs(catalog.active_tags(meta.tag_info, meta.task_info))
    assert [(s.code, s.column, s.value_type) for s in specs] == [("TG_A", "tg_a", "1"), ("TG_B", "tg_b", "3")]


def test_tag_of_task(meta):
    assert catalog.tag_of_task(meta.tag_info, 11)["tag_code"] == "TG_B"
    with pytest.raises(ValueError, match="more than one tag"):
        catalog.tag_of_task(meta.tag_info, 10)
    assert catalog.tag_of_task(meta.tag_info, 12345) is None


def test_missing_task_is_an_error(meta):
    assert catalog.task_by_id(meta.task_info, 12)["task_status"] == "0"
    with pytest.raises(LookupError, match="404"):
        catalog.task_by_id(meta.task_info, 404)


def test_rules_take_the_name_of_their_sub_tag(meta):
    found = rows(catalog.rules_for(meta.rules, meta.tag_info, 11))
    assert found == [(6, "M", "male"), (7, "F", "female")]
    assert catalog.resolved_rules(meta.rules, meta.tag_info).count() == 3


@pytest.mark.parametrize(
    ("specs", "message"),
    [
        ([], "no active tag"),
        ([("TG", "9")], "value type"),
        ([("a b", "1")], "cannot name"),
        ([("A", "1"), ("a", "1")], "taken"),
        ([("UID", "1")], "taken"),
    ],
)
def test_bad_catalogues_are_refused(specs, message):
    with pytest.raises(ValueError, match=message):
        catalog.check_specs([catalog.TagSpec(*s) for s in specs])


def test_metadata_from_tables(spark, database, meta):
    for name in ("tag_info", "task_info"):
        getattr(meta, name).write.saveAsTable(f"{database}.{name}")
    meta.rules.write.saveAsTable(f"{database}.task_tag_rule")
    read = catalog.Metadata.from_tables(spark, database)
    assert rows(read.rules) == rows(meta.rules)


def test_metadata_from_jdbc_reads_the_three_tables(meta):
    from types import SimpleNamespace

    asked = []
    reader = SimpleNamespace(jdbc=lambda url, table, properties: asked.append((url, table, properties)))
    catalog.Metadata.from_jdbc(SimpleNamespace(read=reader), "jdbc:x", {"user": "u"})
    assert [a[1] for a in asked] == ["tag_info", "task_info", "task_tag_rule"]
    assert all(a[0] == "jdbc:x" and a[2] == {"user": "u"} for a in asked)


def test_a_task_with_two_tags_is_an_error(spark):
    info = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "id long, tag_task_id long")
    with pytest.raises(ValueError, match="more than one tag"):
        catalog.tag_of_task(info, 10)
    assert catalog.tag_of_task(info, 11)["id"] == 3 and catalog.tag_of_task(info, 12) is None


def test_the_length_of_a_catalogue_is_up_to_the_caller(spark):
    active = spark.range(30).selectExpr("id", "concat('T', id) as tag_code", "'3' as tag_value_type", "'' as tag_name")
    assert len(catalog.tag_specs(active)) == 30
    with pytest.raises(ValueError, match="more than 29"):
        catalog.tag_specs(active, most=29)
