"""The JDBC export is checked at the writer's and reader's edge: no database is started here."""

from types import SimpleNamespace

import pytest

from tagloom.operators.export import export_files, export_jdbc, jdbc_options


class Writer:
    def __init__(self, calls):
        self.calls = calls

    def mode(self, value):
        self.calls["mode"] = value
        return self

    def options(self, **values):
        self.calls["options"] = values
        return self

    def jdbc(self, url, table, properties):
        self.calls["jdbc"] = (url, table, properties)


def fake_frame(calls, source_rows, target_rows):
    reader = SimpleNamespace(
        jdbc=lambda url, table, properties: SimpleNamespace(
            count=lambda: calls.__setitem__("read", (url, table, properties)) or target_rows
        )
    )
    frame = SimpleNamespace(sparkSession=SimpleNamespace(read=reader), count=lambda: source_rows)
    ordered = SimpleNamespace(
        sortWithinPartitions=lambda column: calls.__setitem__("sort", column) or SimpleNamespace(write=Writer(calls))
    )
    frame.repartitionByRange = lambda n, column: calls.__setitem__("range", (n, column)) or ordered
    return frame


def test_default_options():
    assert jdbc_options() == {"batchsize": "100", "numPartitions": "4", "isolationLevel": "NONE"}


def test_export_replaces_the_target_in_order():
    calls = {}
    export_jdbc(
        fake_frame(calls, 7, 7),
        "jdbc:x",
        "wide",
        driver="some.Driver",
        create_options="ENGINE = MergeTree ORDER BY uid",
        properties={"user": "u"},
    )
    assert calls["mode"] == "overwrite" and calls["sort"] == "uid" and calls["range"] == (4, "uid")
    assert calls["jdbc"] == ("jdbc:x", "wide", {"user": "u"})
    assert calls["options"]["createTableOptions"] == "ENGINE = MergeTree ORDER BY uid"
    assert calls["options"]["driver"] == "some.Driver"
    assert calls["read"] == ("jdbc:x", "wide", {"user": "u", "driver": "some.Driver"})


def test_rows_written_twice_fail_the_export():
    with pytest.raises(RuntimeError, match="8 rows after the export of 7"):
        export_jdbc(fake_frame({}, 7, 8), "jdbc:x", "wide")
    export_jdbc(fake_frame({}, 7, 8), "jdbc:x", "wide", verify=False)


def test_files_are_sorted_and_replaced(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "out")
    users = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("uid"))
    for frame in (users.limit(10), users.orderBy(F.rand(1))):
        export_files(frame, path)
    back = spark.read.parquet(path).select("uid", F.input_file_name().alias("file"))
    assert back.count() == 1000
    files = back.groupBy("file").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi"), F.collect_list("uid").alias("u"))
    spans = sorted((r["lo"], r["hi"]) for r in files.collect())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert all(r["u"] == sorted(r["u"]) for r in files.collect())
