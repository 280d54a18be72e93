"""Every registered query against DuckDB on the same tables; the model queries by their schema."""

import pytest
from compare import connect, difference
from frames import plan_of

import __spark_entry__ as contract
from workload.oracles import ORACLES

SF_DIR = "/root/testdata/sf0.01"

# Operators that no query may need: crossed pairs, and rows passed through Python or one task.
FORBIDDEN = (
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "EvalPython",
    "InPandas",
    "InArrow",
    "SinglePartition",
    "CollectLimit",
    "TakeOrdered",
)


NODES = [
    "node", "parent", "is_left", "depth", "is_leaf", "n", "impurity", "gain", "prediction", "label", "feature",
    "threshold", "left_categories", "right_categories", "unseen_left",
]


@pytest.fixture(scope="module")
def duck():
    con = connect(SF_DIR)
    yield con
    con.close()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    assert not [operator for operator in FORBIDDEN if operator in plan_of(df)]
    assert difference(df, duck, ORACLES[name]) is None


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("model_predictions", ["user_id", "prediction_col", "prediction_origin"]),
        ("model_report", ["metric", "label", "value"]),
        ("feature_weights", ["feature", "weight"]),
        ("sample_model_report", ["metric", "label", "value"]),
        ("predicted_label_tag", ["uid", "tag_value"]),
        ("model_tree_nodes", NODES),
    ],
)
def test_model_queries(spark, name, columns):
    df = contract.queries()[name](spark, SF_DIR)
    assert df.columns == columns and df.count() > 0


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "uid" and df.count() == 150
