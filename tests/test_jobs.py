import pytest
from frames import rows

from tagloom import plans
from tagloom.operators import model
from tagloom.session import scratch_dir, spark_session
from tagloom.sources import catalog
from tagloom.sources.tables import read_day

DAY = "2024-01-31"
TAG = "id bigint, tag_code string, tag_name string, tag_level bigint, tag_value_type string, tag_task_id bigint"
TASK = "id bigint, task_status string, task_sql string"


def metadata(spark, tags=None):
    tags = tags or [(1, "TG_Sex", "sex", 3, "3", 1), (2, "TG_Age", "age", 3, "1", 2)]
    subs = [(11, "S_F", "female", 4, "3", None), (12, "S_M", "male", 4, "3", None)]
    tasks = [
        (1, "1", "select id as uid, sex as query_value from people where day <= '$dt'"),
        (2, "1", "select id as uid, age as query_value from people where day <= '$dt'"),
        (3, "1", "select 1"),
    ]
    return catalog.Metadata(
        spark.createDataFrame(tags + subs, TAG),
        spark.createDataFrame(tasks, TASK),
        spark.createDataFrame([(1, 1, 1, "F", 11), (2, 1, 1, "M", 12)], catalog.RULE_SCHEMA),
    )


@pytest.fixture
def warehouse(spark, tmp_path):
    name = f"wh_{tmp_path.name.replace('-', '_')}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{tmp_path / 'wh'}'")
    people = [(1, "F", "30", "2024-01-01"), (2, "M", "40", "2024-01-01"), (3, "?", "50", "2024-01-31"), (4, "F", "60", "2024-02-01")]
    spark.createDataFrame(people, "id bigint, sex string, age string, day string").write.saveAsTable(f"{name}.people")
    return name


def test_daily_jobs_end_to_end(spark, database, warehouse, tmp_path):
    meta = metadata(spark)
    for task in (1, 2, 1):  # a task run twice is the same as run once
        plans.run_tag_task(spark, meta, task, DAY, database, warehouse, base=str(tmp_path / "base"))
    assert spark.catalog.currentDatabase() == "default"
    assert rows(read_day(spark, f"{database}.tg_sex", DAY)) == [
        ("1", "female", DAY),
        ("2", "male", DAY),
        ("3", None, DAY),
    ]
    assert spark.table(f"{database}.tg_age").schema["tag_value"].dataType.simpleString() == "bigint"

    wide = plans.run_merge(spark, meta, DAY, database)
    assert wide == f"{database}.wide_tags_20240131"
    assert rows(spark.table(wide)) == [("1", "female", "30"), ("2", "male", "40"), ("3", "", "50")]

    for _ in range(2):
        members = plans.run_bitmaps(spark, meta, DAY, database)
    got = rows(spark.table(members).select("value_type", "tag_code", "tag_value", "n_users", "dt"))
    assert got == [
        ("1", "TG_Age", "30", 1, DAY),
        ("1", "TG_Age", "40", 1, DAY),
        ("1", "TG_Age", "50", 1, DAY),
        ("3", "TG_Sex", "female", 1, DAY),
        ("3", "TG_Sex", "male", 1, DAY),
    ]

    # A type that has no tag any more is cleared for the day.
    fewer = metadata(spark, [(1, "TG_Sex", "sex", 3, "3", 1)])
    plans.run_bitmaps(spark, fewer, DAY, database)
    assert {r["value_type"] for r in spark.table(members).collect()} == {"3"}


def test_other_days_stay(spark, database, warehouse):
    meta = metadata(spark)
    for day in ("2024-01-01", "2024-02-01"):
        for task in (1, 2):
            plans.run_tag_task(spark, meta, task, day, database, warehouse)
        plans.run_merge(spark, meta, day, database, prefix="merged", one_value=True)
    assert spark.table(f"{database}.merged_20240101").count() == 2
    assert spark.table(f"{database}.merged_20240201").count() == 4


def test_failed_task_keeps_the_current_database(spark, database, warehouse):
    meta = metadata(spark)
    broken = catalog.Metadata(
        meta.tag_info, spark.createDataFrame([(1, "1", "select nothing from nowhere")], TASK), meta.rules
    )
    with pytest.raises(Exception, match="nowhere"):
        plans.run_tag_task(spark, broken, 1, DAY, database, warehouse)
    assert spark.catalog.currentDatabase() == "default"
    with pytest.raises(LookupError, match="no tag"):
        plans.run_tag_task(spark, meta, 3, DAY, database)
    with pytest.raises(LookupError, match="no task"):
        plans.run_tag_task(spark, catalog.Metadata(meta.tag_info, broken.task_info, meta.rules), 2, DAY, database)


def test_export_job_names_the_target_like_the_table(spark, database, warehouse, monkeypatch):
    meta = metadata(spark)
    for task in (1, 2):
        plans.run_tag_task(spark, meta, task, DAY, database, warehouse)
    plans.run_merge(spark, meta, DAY, database)
    seen = {}
    monkeypatch.setattr(
        "tagloom.operators.export.export_jdbc", lambda df, url, table, **kw: seen.update(n=df.count(), table=table, **kw)
    )
    plans.run_export(spark, DAY, database, "jdbc:x", partitions=8)
    assert seen == {"n": 3, "table": "wide_tags_20240131", "properties": None, "partitions": 8}


def test_train_and_predict_jobs(spark, database, tmp_path):
    from workload import roles

    sf = "/root/testdata/sf0.01"
    logs = roles.page_logs(spark, sf).withColumn("page_id", roles.F.lit("good_detail"))
    inputs = (logs, roles.items(spark, sf), roles.users(spark, sf))
    path, table = str(tmp_path / "model"), f"{database}.tg_label"
    _, report = plans.run_training(*inputs, path, "2024-01-01", DAY)
    assert report.filter("metric = 'accuracy'").count() == 1
    for _ in range(2):
        plans.run_prediction(spark, *inputs, path, DAY, table, dt_from="2024-01-01")
    tag = spark.table(table)
    assert tag.columns == ["uid", "tag_value", "dt"]
    declared = inputs[2].filter("gender is not null").count()
    assert tag.count() > declared
    assert tag.groupBy("uid").count().filter("count > 1").count() == 0
    assert {r[0] for r in tag.select("tag_value").distinct().collect()} <= {"女", "男"}


def test_scratch_folder_lies_below_the_checkpoint_folder(spark):
    a, b = scratch_dir(spark), scratch_dir(spark)
    assert a != b and a.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_session_helper_reuses_the_session(spark):
    assert spark_session("again").sparkContext is spark.sparkContext


def test_command_line_runs_the_daily_jobs(spark, database, warehouse):
    from tagloom.__main__ import main, parse

    meta = metadata(spark)
    for name, frame in (("tag_info", meta.tag_info), ("task_info", meta.task_info), ("task_tag_rule", meta.rules)):
        frame.write.saveAsTable(f"{warehouse}.{name}")
    shared = ["--dt", DAY, "--database", database, "--metadata", warehouse]
    for task in ("1", "2"):
        main(["tag", *shared, "--task", task, "--warehouse", warehouse])
    main(["merge", *shared, "--one-value", "TG_Sex", "TG_Age"])
    main(["bitmaps", *shared])
    assert rows(spark.table(f"{database}.wide_tags_20240131")) == [
        ("1", "female", "30"),
        ("2", "male", "40"),
        ("3", "", "50"),
    ]
    assert spark.table(f"{database}.{plans.BITMAP_TABLE}").count() == 5
    args = parse(["export", *shared, "--url", "jdbc:x", "--partitions", "8"])
    assert (args.job, args.url, args.partitions) == ("export", "jdbc:x", 8)


def test_one_query_computes_several_tags(spark, database, warehouse):
    """The tables of a shared query are those of the tags' own queries; members as containers of unsigned ids."""
    from tagloom.__main__ import main

    meta = metadata(spark)
    for name, frame in (("tag_info", meta.tag_info), ("task_info", meta.task_info), ("task_tag_rule", meta.rules)):
        frame.write.mode("overwrite").saveAsTable(f"{warehouse}.{name}")
    shared = ["--dt", DAY, "--database", database, "--metadata", warehouse]
    for task in ("1", "2"):
        main(["tag", *shared, "--task", task, "--warehouse", warehouse])
    alone = {t: rows(spark.table(f"{database}.{t}")) for t in ("tg_sex", "tg_age")}
    sql = "select id as uid, sex as TG_Sex, age as TG_Age from people where day <= '$dt'"
    for _ in range(2):
        main(["tags", *shared, "--tasks", "1", "2", "--warehouse", warehouse, "--sql", sql])
    assert {t: rows(spark.table(f"{database}.{t}")) for t in alone} == alone
    assert spark.catalog.currentDatabase() == "default"
    main(["merge", *shared])
    main(["bitmaps", *shared, "--unsigned", "--runs"])
    held = spark.table(f"{database}.{plans.CONTAINER_TABLE}")
    assert held.count() == 5 and held.filter("size(runs) > 0").count() == 5
    with pytest.raises(LookupError, match="no tag"):
        plans.run_shared_tasks(spark, meta, [1, 3], DAY, database, sql, warehouse)
    with pytest.raises(ValueError, match="missing"):
        plans.run_shared_tasks(spark, meta, [1, 2], DAY, database, "select 1 as uid, 2 as tg_sex")


def test_the_sample_model_as_a_job(spark, database, tmp_path, capsys):
    """The stored model finds the rule that the labels follow; the job shows tree, weights, report and scored rows."""
    from tagloom.__main__ import main
    from workload import roles

    samples = roles.samples(spark, "/root/testdata/sf0.01")
    samples.write.saveAsTable(f"{database}.samples")
    path = str(tmp_path / "sample")
    main(["train-sample", "--dt", DAY, "--database", database, "--model", path, "--samples", f"{database}.samples", "--preview", "3"])
    shown = capsys.readouterr().out
    assert "If (feature" in shown and "prediction_origin" in shown and "accuracy" in shown
    _, report, scored = plans.run_sample_training(samples, path, seed=7)
    assert scored.filter("prediction_origin <> gender").count() == 0 and scored.count() > 300
    assert report.filter("metric = 'accuracy'").first()["value"] == 1.0
    assert len(model.model_versions(spark, path)) == 2
