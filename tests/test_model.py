import pytest
from frames import rows
from pyspark.sql import functions as F

from tagloom.operators import labels, model
from tagloom.operators.features import feature_columns


@pytest.fixture(scope="module")
def people(spark):
    """Users whose label follows the longer dwell, with a few exceptions."""
    ids = spark.range(400)
    male = (F.col("id") * 7919 % 101).cast("bigint")
    female = (F.col("id") * 104729 % 97).cast("bigint")
    truth = F.when(male >= female, "M").otherwise("F")
    return ids.select(
        F.col("id").alias("user_id"),
        (F.col("id") % 7).alias("c1_rk1"),
        (F.col("id") % 5).alias("c1_rk2"),
        F.lit(0).cast("bigint").alias("c1_rk3"),
        male.alias("male_dur"),
        female.alias("female_dur"),
        F.when(F.col("id") % 50 == 0, "F").otherwise(truth).alias("gender"),
    )


@pytest.fixture(scope="module")
def trained(people):
    return model.train(people, "gender", feature_columns(), model.BEHAVIOUR_PARAMS, seed=3)


def test_split_is_whole_stable_and_near_its_share(spark, people):
    a, b = model.split_by_key(people, "user_id", 0.8, seed=3)
    again, _ = model.split_by_key(people.repartition(7), "user_id", 0.8, seed=3)
    other, _ = model.split_by_key(people, "user_id", 0.8, seed=4)
    assert a.count() + b.count() == 400 and a.join(b, "user_id").count() == 0
    assert rows(a) == rows(again) and rows(a) != rows(other)
    assert 280 <= a.count() <= 360


def test_stages_follow_the_parameters(trained):
    fitted, _ = trained
    indexer, assembler, features, tree = fitted.stages
    assert indexer.labels[0] in ("M", "F") and len(indexer.labels) == 2
    assert assembler.getInputCols() == feature_columns()
    assert features.getMaxCategories() == 20
    p = tree
    assert (p.getMaxDepth(), p.getMaxBins(), p.getMinInstancesPerNode(), p.getMinInfoGain()) == (6, 32, 3, 0.02)
    assert p.getImpurity() == "gini"


def test_defaults():
    p = model.TreeParams()
    assert (p.max_categories, p.max_bins, p.max_depth, p.min_instances, p.min_info_gain) == (5, 5, 5, 1, 0.0)
    assert p.with_(max_depth=9).max_depth == 9 and p.new_categories == "keep"


def test_predictions_are_labels_of_the_training_set(trained):
    fitted, held_out = trained
    out = model.predict(fitted, held_out)
    assert {"prediction_col", "prediction_origin", "label_index"} <= set(out.columns)
    assert {r[0] for r in out.select("prediction_origin").collect()} <= {"M", "F"}
    unlabelled = model.predict(fitted, held_out.drop("gender"))
    assert rows(unlabelled.select("user_id", "prediction_origin")) == rows(out.select("user_id", "prediction_origin"))


def test_report_of_a_good_model(trained):
    fitted, held_out = trained
    report = {(r["metric"], r["label"]): r["value"] for r in model.evaluate(model.predict(fitted, held_out)).collect()}
    assert set(report) == {("accuracy", None)} | {(m, x) for m in ("precision", "recall") for x in (0.0, 1.0)}
    assert all(0 <= v <= 1 for v in report.values())
    assert report[("accuracy", None)] > 0.7


def test_report_matches_the_evaluator(trained):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    fitted, held_out = trained
    predicted = model.predict(fitted, held_out)
    report = {(r["metric"], r["label"]): r["value"] for r in model.evaluate(predicted).collect()}
    for metric, name in (("precision", "precisionByLabel"), ("recall", "recallByLabel")):
        for label in (0.0, 1.0):
            official = MulticlassClassificationEvaluator(
                labelCol="label_index", predictionCol="prediction_col", metricName=name, metricLabel=label
            ).evaluate(predicted)
            assert report[(metric, label)] == pytest.approx(official)


def test_report_of_labels_never_predicted_or_never_true(spark):
    data = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "a"), ("a", "z")], "label string, guess string")
    got = {(r["metric"], r["label"]): r["value"] for r in model.evaluate(data, "label", "guess").collect()}
    assert got == {
        ("accuracy", None): 0.25,
        ("recall", "a"): pytest.approx(1 / 3),
        ("recall", "b"): 0.0,
        ("precision", "a"): 0.5,
        ("precision", "b"): 0.0,
    }
    never = spark.createDataFrame([("a", "b")], "label string, guess string")
    assert {(r["metric"], r["label"]): r["value"] for r in model.evaluate(never, "label", "guess").collect()} == {
        ("accuracy", None): 0.0,
        ("recall", "a"): 0.0,
        ("precision", "a"): 0.0,
    }


def test_explain(spark, trained):
    fitted, _ = trained
    text = model.tree_text(fitted)
    assert "If (feature" in text
    weights = {r["feature"]: r["weight"] for r in model.feature_weights(spark, fitted).collect()}
    assert list(weights) == feature_columns()
    assert sum(weights.values()) == pytest.approx(1.0)
    assert weights["male_dur"] + weights["female_dur"] > 0.8


def test_save_and_load_predict_the_same(trained, tmp_path):
    fitted, held_out = trained
    path = str(tmp_path / "model")
    for _ in range(2):  # the second save replaces the first
        model.save(fitted, path)
    columns = ("user_id", "prediction_origin")
    before = model.predict(fitted, held_out).select(*columns)
    after = model.predict(model.load(path), held_out).select(*columns)
    assert rows(before) == rows(after)


def test_null_features_are_a_code_of_their_own(people):
    broken = people.withColumn("c1_rk1", F.when(F.col("user_id") % 10 != 0, F.col("c1_rk1")))
    fitted = model.fit(broken, "gender", feature_columns(), model.BEHAVIOUR_PARAMS)
    predicted = model.predict(fitted, broken)
    assert predicted.count() == people.count()
    coded = model.predict(fitted, broken.fillna(-1, feature_columns()))
    columns = ["user_id", model.PREDICTION_LABEL]
    assert rows(predicted.select(*columns)) == rows(coded.select(*columns))


def test_new_categories_fail_or_are_kept(people):
    new = people.withColumn("c1_rk1", F.when(F.col("user_id") < 100, 777).otherwise(F.col("c1_rk1")).cast("bigint"))
    for choice, expected in (("error", None), ("keep", 400)):
        params = model.BEHAVIOUR_PARAMS.with_(new_categories=choice)
        fitted = model.fit(people, "gender", feature_columns(), params)
        if expected is None:
            with pytest.raises(Exception, match="777"):
                model.predict(fitted, new).collect()
        else:
            assert model.predict(fitted, new).count() == expected


def test_parameters_are_checked():
    for choice in ("drop", "skip"):
        with pytest.raises(ValueError, match="new_categories"):
            model.TreeParams(new_categories=choice)


def test_label_tag_is_prediction_and_declaration(spark):
    predicted = spark.createDataFrame([(1, "F"), (2, "M")], "user_id bigint, prediction_origin string")
    users = spark.createDataFrame(
        [(1, None), (2, None), (3, "F"), (4, "x"), (5, "")], "id bigint, gender string"
    ).withColumn("dt", F.lit("9999-99-99"))
    words = {str(i): w for i, w in zip(range(1, 6), ["女", "男", "女", "男", "男"], strict=True)}
    assert dict(rows(labels.predicted_label_tag(predicted, users))) == words
    strict = dict(rows(labels.predicted_label_tag(predicted, users, treat_empty_as_missing=True)))
    assert strict == {k: v for k, v in words.items() if k != "5"}
    custom = labels.declared_label_tag(users, {"F": "f", "x": "x"}, "other")
    assert dict(rows(custom)) == {"3": "f", "4": "x", "5": "other"}


def test_a_failing_save_leaves_the_earlier_model(spark, trained, people, tmp_path, monkeypatch):
    fitted, held_out = trained
    path = str(tmp_path / "model")
    first = model.save(fitted, path)
    want = rows(model.predict(model.load(path), held_out).select("user_id", "prediction_col"))

    def broken(folder):
        raise OSError("half-written")

    with monkeypatch.context() as patch:
        patch.setattr(model.PipelineModel, "load", broken)
        with pytest.raises(OSError, match="half-written"):
            model.save(fitted, path)
    assert model.current_folder(path) == first and len(model.model_versions(spark, path)) == 1
    assert rows(model.predict(model.load(path), held_out).select("user_id", "prediction_col")) == want


def test_versions_of_a_model(spark, trained, tmp_path):
    fitted, _ = trained
    path = str(tmp_path / "model")
    folders = [model.save(fitted, path, keep=1) for _ in range(3)]
    assert [f"{path}/{v}" for v in model.model_versions(spark, path)] == folders[1:]
    assert model.current_folder(path) == folders[-1] and model.load(path).uid == fitted.uid
    fitted.write().save(str(tmp_path / "plain"))  # as earlier releases wrote it
    assert model.load(str(tmp_path / "plain")).uid == fitted.uid


def test_duckdb_scores_the_exported_tree(spark, trained, people, tmp_path):
    """The node table alone, walked from the root in another engine, gives the model's predictions."""
    import duckdb

    fitted, _ = trained
    path, names = str(tmp_path / "model"), feature_columns()
    model.save(fitted, path)
    odd = people.withColumn("c1_rk2", F.when(F.col("user_id") % 9 == 0, 77).otherwise(F.col("c1_rk2")))  # never seen
    odd = odd.withColumn("c1_rk1", F.when(F.col("user_id") % 11 > 0, F.col("c1_rk1")))  # and NULL
    nodes = model.tree_nodes(spark, path)
    nodes.write.parquet(str(tmp_path / "nodes"))
    odd.write.parquet(str(tmp_path / "people"))
    con = duckdb.connect()
    con.execute(f"create view nodes as select * from '{tmp_path}/nodes/*.parquet'")
    con.execute(f"create view people as select * from '{tmp_path}/people/*.parquet'")
    values = " union all ".join(f"select user_id, '{n}' as feature, coalesce({n}, -1)::double as value from people" for n in names)
    walked = con.execute(f"""
        with recursive long as ({values}), walk as (
            select user_id, 0 as node from people
            union all
            select w.user_id, c.node
            from walk w join nodes n on w.node = n.node and not n.is_leaf
            join long l on l.user_id = w.user_id and l.feature = n.feature
            join nodes c on c.parent = n.node and c.is_left = (case
                when n.threshold is not null then l.value <= n.threshold
                when n.unseen_left then not list_contains(n.right_categories, l.value)
                else list_contains(n.left_categories, l.value) end)
        )
        select w.user_id, n.prediction, n.label from walk w join nodes n on w.node = n.node where n.is_leaf""").fetchall()
    by_model = model.predict(model.load(path), odd).select("user_id", "prediction_col", "prediction_origin")
    assert sorted(walked) == sorted(map(tuple, by_model.collect()))
    by_paths = model.score_by_paths(odd, model.tree_paths(nodes), names)
    assert sorted(map(tuple, by_paths.select("user_id", "prediction_col", "prediction_origin").collect())) == sorted(walked)
    weights = {r.feature: r.weight for r in model.feature_weights(spark, fitted).collect()}
    assert {r.feature: pytest.approx(r.weight) for r in model.node_weights(nodes, names).collect()} == weights
