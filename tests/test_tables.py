from decimal import Decimal

import pytest
from frames import rows

from tagloom.functions import check_day, day_suffix
from tagloom.sources import tables


def tag(spark, *pairs, kind="bigint"):
    return spark.createDataFrame(list(pairs), f"uid string, tag_value {kind}")


@pytest.mark.parametrize("tab_text", [False, True])
def test_overwriting_a_day_leaves_other_days(spark, database, tab_text):
    name = f"{database}.tg_x"
    tables.create_tag_table(spark, name, "1", tab_text=tab_text)
    tables.overwrite_day(tag(spark, ("a", 1), ("b", 2)), name, "2024-01-01")
    tables.overwrite_day(tag(spark, ("a", 3)), name, "2024-01-02")
    tables.overwrite_day(tag(spark, ("c", 9)), name, "2024-01-01")
    tables.overwrite_day(tag(spark, ("c", 9)), name, "2024-01-01")
    assert rows(spark.table(name)) == [("a", 3, "2024-01-02"), ("c", 9, "2024-01-01")]
    assert rows(tables.read_day(spark, name, "2024-01-02")) == [("a", 3, "2024-01-02")]


def test_tab_text_keeps_every_value(spark, database):
    """Tabs, quotes, backslashes, empty text and NULL come back; a line break fails the job."""
    name = f"{database}.tg_x"
    tables.create_tag_table(spark, name, "3", tab_text=True)
    values = ["a\tb", 'say "hi"', "back\\slash", "trailing\\", "", None, " spaced ", "女", "#hash", "it's"]
    frame = tag(spark, *((f"u{i}", v) for i, v in enumerate(values)), kind="string")
    tables.overwrite_day(frame, name, "2024-01-01")
    assert [r["tag_value"] for r in spark.table(name).orderBy("uid").collect()] == values
    with pytest.raises(Exception, match="line break"):
        tables.overwrite_day(tag(spark, ("u", "two\nlines"), kind="string"), name, "2024-01-02")


@pytest.mark.parametrize("mode", ["static", "dynamic"])
def test_an_empty_frame_empties_the_day(spark, database, mode):
    name = f"{database}.tg_x"
    tables.create_tag_table(spark, name, "1")
    spark.conf.set(tables.OVERWRITE_MODE, mode)
    try:
        tables.overwrite_day(tag(spark, ("a", 1)), name, "2024-01-01")
        tables.overwrite_day(tag(spark, ("a", 1)), name, "2024-01-02")
        tables.overwrite_day(tag(spark, ("a", 1)).limit(0), name, "2024-01-01")
        assert spark.conf.get(tables.OVERWRITE_MODE) == mode
    finally:
        spark.conf.unset(tables.OVERWRITE_MODE)
    assert rows(spark.table(name)) == [("a", 1, "2024-01-02")]


@pytest.mark.parametrize("mode", ["static", "dynamic"])
def test_partitions_below_the_day_are_cleared_too(spark, database, mode):
    name = f"{database}.sets"
    tables.create_day_table(spark, name, "v bigint", "dt string, value_type string")
    frame = spark.createDataFrame([(1, "1"), (2, "3")], "v bigint, value_type string")
    spark.conf.set(tables.OVERWRITE_MODE, mode)
    try:
        for day in ("2024-01-01", "2024-01-02"):
            tables.overwrite_day(frame, name, day, dynamic=("value_type",))
        tables.overwrite_day(frame.filter("value_type = '3'"), name, "2024-01-02", dynamic=("value_type",))
    finally:
        spark.conf.unset(tables.OVERWRITE_MODE)
    assert rows(spark.table(name)) == [
        (1, "2024-01-01", "1"),
        (2, "2024-01-01", "3"),
        (2, "2024-01-02", "3"),
    ]


def test_columns_go_by_name(spark, database):
    name = f"{database}.tg_x"
    tables.create_tag_table(spark, name, "3")
    swapped = tag(spark, ("user", "value"), kind="string").select("tag_value", "uid")
    tables.overwrite_day(swapped, name, "2024-01-01")
    assert rows(spark.table(name)) == [("user", "value", "2024-01-01")]


def test_types_null_and_comment_survive(spark, database, tmp_path):
    name = f"{database}.tg_x"
    place = str(tmp_path / "elsewhere")
    for _ in range(2):  # the second time the table is there
        tables.create_tag_table(spark, name, "2", location=place, comment="it's a tag")
    frame = tag(spark, ("a", Decimal("1.50")), ("b", None), kind="decimal(16,2)")
    tables.overwrite_day(frame, name, "2024-01-01")
    assert rows(spark.table(name)) == [("a", Decimal("1.50"), "2024-01-01"), ("b", None, "2024-01-01")]
    details = {r[0]: r[1] for r in spark.sql(f"describe extended {name}").collect()}
    assert details["Comment"] == "it's a tag" and "elsewhere" in details["Location"]


def test_only_the_day_is_scanned(spark, database):
    name = f"{database}.tg_x"
    tables.create_tag_table(spark, name, "1")
    tables.overwrite_day(tag(spark, ("a", 1)), name, "2024-01-01")
    plan = tables.read_day(spark, name, "2024-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_current_slice_uses_the_sentinel(spark, database):
    name = f"{database}.people"
    tables.create_day_table(spark, name, "id bigint")
    for day, value in (("2024-01-01", 1), (tables.CURRENT_DAY, 2)):
        tables.overwrite_day(spark.createDataFrame([(value,)], "id bigint"), name, day)
    assert rows(tables.read_current(spark, name)) == [(2, "9999-99-99")]


def test_replace_table_takes_new_columns(spark, database, tmp_path):
    name = f"{database}.wide"
    for frame in ("select 1 as uid, 2 as a", "select 3 as uid, 4 as b, 5 as c"):
        tables.replace_table(spark.sql(frame), name, str(tmp_path / "wide"), "wide table")
    assert spark.table(name).columns == ["uid", "b", "c"]
    assert rows(spark.table(name)) == [(3, 4, 5)]


def test_view_and_preview(spark):
    view = tables.publish_view(spark.range(500), "many_rows")
    assert spark.sql("select count(*) from many_rows").first()[0] == 500
    assert tables.preview(view).count() == 100


def test_days():
    assert day_suffix("2024-01-31") == "20240131"
    assert check_day("9999-99-99") == "9999-99-99"
    for bad in ("20240131", "2024-01-31 ", "", "2024-01-31\n"):
        with pytest.raises(ValueError):
            check_day(bad)


def test_text_tables_keep_what_looks_like_null(spark, database):
    values = [r"\N", r"\\N", r"\\\N", "a\tb", 'q"u"ote', "'", r"\n", "N", "", " ", None, r"x\N"]
    name = f"{database}.tg_marks"
    tables.create_tag_table(spark, name, "3", tab_text=True)
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "uid string, tag_value string")
    tables.overwrite_day(df, name, "2024-01-31")
    got = {r.uid: r.tag_value for r in tables.read_day(spark, name, "2024-01-31").collect()}
    assert got == {str(i): v for i, v in enumerate(values)}


@pytest.mark.parametrize("located", [False, True])
def test_a_failing_rebuild_leaves_the_earlier_table(spark, database, tmp_path, located):
    name, place = f"{database}.wide", str(tmp_path / "place") if located else None
    tables.replace_table(spark.sql("select 1 as a"), name, place)
    with pytest.raises(Exception, match="broken"):
        tables.replace_table(spark.sql("select raise_error('broken') as b"), name, place)
    assert rows(spark.table(name)) == [(1,)]
    tables.replace_table(spark.sql("select 2 as c"), name, place)
    assert spark.table(name).columns == ["c"] and rows(spark.table(name)) == [(2,)]
    assert len(tables.table_versions(spark, name)) == 2  # the one before stays for its readers
    tables.replace_table(spark.sql("select 3 as c"), name, place, comment="it's wide", keep=0)
    assert len(tables.table_versions(spark, name)) == 1 and rows(spark.table(name)) == [(3,)]
    if located:
        assert len([p for p in (tmp_path / "place").iterdir() if p.name.startswith("version_")]) == 1


def test_a_reader_never_misses_the_table(spark, database):
    """A thread reads all the time while the table is published again and again with other columns."""
    import threading

    name = f"{database}.wide"
    tables.replace_table(spark.sql("select 0 as v, 0 as c0"), name)
    seen, failed, stop = [], [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                (row,) = spark.table(name).collect()
                seen.append(row["v"])
                assert f"c{row['v']}" in row.asDict()
            except Exception as error:  # noqa: BLE001
                failed.append(error)

    reader = threading.Thread(target=read)
    reader.start()
    for v in range(1, 9):
        tables.replace_table(spark.sql(f"select {v} as v, {v} as c{v}"), name, keep=2)
    stop.set()
    reader.join()
    assert not failed and len(seen) >= 8 and seen == sorted(seen)


def test_a_plain_table_of_the_name_becomes_the_first_version(spark, database):
    name = f"{database}.wide"
    spark.sql("select 1 as a").write.saveAsTable(name)
    tables.replace_table(spark.sql("select 2 as b"), name)
    assert rows(spark.table(name)) == [(2,)]
    assert [rows(spark.table(v)) for v in tables.table_versions(spark, name)] == [[(1,)], [(2,)]]
