"""Every option of the daily jobs reaches its operator."""

import pytest

from tagloom import __main__ as cli


@pytest.fixture
def calls(monkeypatch):
    """What the jobs were called with."""
    seen = {}

    def called(name):
        def job(*args, **options):
            seen[name] = (args, options)
            return (None, Shown()) if name == "run_training" else None

        return job

    class Shown:
        def show(self, *args, **options):
            pass

    class Session:
        def table(self, name):
            return name

    for name in ("run_tag_task", "run_merge", "run_export", "run_bitmaps", "run_training", "run_prediction"):
        monkeypatch.setattr(cli.plans, name, called(name))
    monkeypatch.setattr(cli, "spark_session", lambda app, hive: seen.__setitem__("hive", hive) or Session())
    monkeypatch.setattr(cli, "tree_text", lambda fitted: "tree")
    monkeypatch.setattr(cli, "feature_weights", lambda spark, fitted: Shown())
    monkeypatch.setattr(cli.Metadata, "from_tables", lambda spark, database: ("tables", database))
    monkeypatch.setattr(cli.Metadata, "from_jdbc", lambda spark, url, properties: ("jdbc", url, properties))
    return seen


DAY = ["--dt", "2024-01-31", "--database", "tags"]
LABEL = ["--model", "m", "--logs", "l", "--items", "i", "--users", "u"]


def test_tag_options(calls):
    cli.main(["tag", *DAY, "--task", "7", "--tab-text", "--lenient", "--hive", "--warehouse", "w", "--base", "/b"])
    args, options = calls["run_tag_task"]
    assert args[1:] == (("tables", "tags"), 7, "2024-01-31", "tags", "w", "/b")
    assert options == {"strict": False, "tab_text": True} and calls["hive"]


def test_metadata_over_jdbc(calls):
    more = ["--metadata-url", "jdbc:x", "--metadata-property", "user=a", "--metadata-property", "password=b=c"]
    cli.main(["bitmaps", *DAY, *more])
    assert calls["run_bitmaps"][0][1] == ("jdbc", "jdbc:x", {"user": "a", "password": "b=c"}) and not calls["hive"]


def test_export_options(calls):
    more = ["--batchsize", "500", "--isolation", "NONE", "--property", "user=a", "--partitions", "9", "--driver", "d"]
    cli.main(["export", *DAY, "--url", "jdbc:y", *more])
    args, options = calls["run_export"]
    assert args[1:4] == ("2024-01-31", "tags", "jdbc:y") and args[5] == {"user": "a"}
    assert options == {"driver": "d", "partitions": 9, "create_options": None, "batchsize": 500, "isolation": "NONE"}


def test_model_options(calls):
    shared = ["--page-id", "p", "--item-type", "t", "--item-dt", "2024-01-30", "--top", "5", "--dwell-set", "x=1,2"]
    cli.main(["train", *DAY, *LABEL, *shared, "--new-categories", "error", "--seed", "4", "--dt-from", "2024-01-01"])
    args, options = calls["run_training"]
    assert args[:6] == ("l", "i", "u", "m", "2024-01-01", "2024-01-31")
    assert args[6].new_categories == "error" and args[7] == 4
    want = {"k": 5, "sets": {"x": (1, 2)}, "item_dt": "2024-01-30", "page_id": "p", "item_type": "t"}
    assert options == want
    cli.main(["predict", *DAY, *LABEL, *shared, "--table", "tg", "--base", "/b/", "--treat-empty-as-missing"])
    args, options = calls["run_prediction"]
    assert args[5:] == ("2024-01-31", "tags.tg", None, "/b/tags/tg", True) and options == want
