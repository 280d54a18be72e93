"""The label model: a decision tree over assembled and indexed features."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler, VectorIndexer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import remove_folder

# Columns that the fitted stages read and write.
LABEL_INDEX = "label_index"
PREDICTION = "prediction_col"
PREDICTION_LABEL = "prediction_origin"
FEATURE_VECTOR = "feature_assemble"
INDEXED_FEATURES = "feature_index"

# What a NULL feature counts as; category numbers and dwell sums are never negative.
NULL_FEATURE = -1


@dataclass(frozen=True)
class TreeParams:
    """Tree settings. ``max_categories`` is the most distinct values a categorical feature may have.

    ``new_categories`` says what a category unseen in training does: ``keep`` it as one further category, or
    ``error``. No setting leaves rows out.
    """

    max_categories: int = 5
    max_bins: int = 5
    max_depth: int = 5
    min_instances: int = 1
    min_info_gain: float = 0.0
    new_categories: str = "keep"

    def __post_init__(self) -> None:
        if self.new_categories not in ("error", "keep"):
            raise ValueError("new_categories is error or keep")

    def with_(self, **changes: object) -> TreeParams:
        return replace(self, **changes)


# The settings of the two models.
BEHAVIOUR_PARAMS = TreeParams(
    max_categories=20, max_bins=32, max_depth=6, min_instances=3, min_info_gain=0.02
)
SAMPLE_PARAMS = TreeParams(
    max_categories=5, max_bins=64, max_depth=6, min_instances=4, min_info_gain=0.1
)


def split_by_key(
    df: DataFrame, key: str, train_share: float = 0.8, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows, decided by a hash of the key and the seed.

    Unlike a per-partition random draw, a row keeps its side when a lost task is recomputed or the
    cluster changes size, so no row is ever in both frames or in neither.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 10_000
    cut = round(train_share * 10_000)
    return df.filter(draw < cut), df.filter(draw >= cut)


def coded_nulls(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """A NULL feature as a number of its own, so that its row is trained on and scored like any other."""
    kinds = dict(df.dtypes)
    return df.withColumns({f: F.coalesce(F.col(f), F.lit(NULL_FEATURE).cast(kinds[f])) for f in features})


def build_pipeline(label: str, features: Sequence[str], params: TreeParams = TreeParams()) -> Pipeline:
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol=LABEL_INDEX),
            VectorAssembler(
                inputCols=list(features),
                outputCol=FEATURE_VECTOR,
                handleInvalid="error",
            ),
            VectorIndexer(
                inputCol=FEATURE_VECTOR,
                outputCol=INDEXED_FEATURES,
                maxCategories=params.max_categories,
                handleInvalid=params.new_categories,
            ),
            DecisionTreeClassifier(
                labelCol=LABEL_INDEX,
                featuresCol=INDEXED_FEATURES,
                predictionCol=PREDICTION,
                impurity="gini",
                maxDepth=params.max_depth,
                maxBins=params.max_bins,
                minInstancesPerNode=params.min_instances,
                minInfoGain=params.min_info_gain,
            ),
        ]
    )


def fit(df: DataFrame, label: str, features: Sequence[str], params: TreeParams = TreeParams()) -> PipelineModel:
    """Fit on all rows. The fit reads its input once per stage and tree level, so it is kept meanwhile."""
    kept = coded_nulls(df.select(label, *features), features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return build_pipeline(label, features, params).fit(kept)
    finally:
        kept.unpersist()


def train(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    params: TreeParams = TreeParams(),
    seed: int = 0,
    key: str = "user_id",
) -> tuple[PipelineModel, DataFrame]:
    """Fit on the training share; returns the model and the held-out rows."""
    training, held_out = split_by_key(df, key, seed=seed)
    return fit(training, label, features, params), held_out


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add the predicted index and the label it stands for to every row. The label column is not needed."""
    back = IndexToString(
        inputCol=PREDICTION, outputCol=PREDICTION_LABEL, labels=model.stages[0].labels
    )
    return back.transform(model.transform(coded_nulls(df, model.stages[1].getInputCols())))


def tree_text(model: PipelineModel) -> str:
    """The whole tree as indented text."""
    return model.stages[3].toDebugString


def label_index(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """``(label, idx)``: the most frequent label of the training rows is 0, equal ones are in text order."""
    pairs = [(label, i) for i, label in enumerate(model.stages[0].labels)]
    return spark.createDataFrame(pairs, "label string, idx int")


def feature_categories(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """``(feature, category, idx)`` of the features that the model takes as categories."""
    names = model.stages[1].getInputCols()
    maps = model.stages[2].categoryMaps
    rows = [(names[i], float(value), int(at)) for i, pairs in maps.items() for value, at in pairs.items()]
    return spark.createDataFrame(rows, "feature string, category double, idx int")


def feature_weights(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """``(feature, weight)``, one row per feature."""
    names = model.stages[1].getInputCols()
    weights = model.stages[3].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, weights, strict=True)), "feature string, weight double")


def evaluate(
    predicted: DataFrame, label: str = LABEL_INDEX, prediction: str = PREDICTION
) -> DataFrame:
    """Report rows ``(metric, label, value)``: accuracy, and precision and recall of each true label.

    The pairs are counted first, so what follows handles one row per pair of classes. A label that is
    never predicted has precision 0, and a predicted label that never occurs has no row.
    """
    pairs = predicted.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("guess")).agg(
        F.count("*").alias("n")
    )
    n = F.col("n")
    hit = F.when(F.col("actual") == F.col("guess"), n).otherwise(0)
    none = F.lit(None).cast(predicted.schema[label].dataType)
    zero = F.lit(0).cast("bigint")

    def share(metric: str, of: Column, part: Column, whole: Column, occurs: bool) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            of.alias("label"),
            part.alias("part"),
            whole.alias("whole"),
            F.lit(occurs).alias("occurs"),
        )

    shares = pairs.select(
        F.inline(
            F.array(
                share("accuracy", none, hit, n, True),
                share("recall", F.col("actual"), hit, n, True),
                share("precision", F.col("guess"), hit, n, False),
                share("precision", F.col("actual"), zero, zero, True),
            )
        )
    )
    summed = shares.groupBy("metric", "label").agg(
        F.sum("part").alias("part"), F.sum("whole").alias("whole"), F.bool_or("occurs").alias("occurs")
    )
    value = F.when(F.col("whole") == 0, F.lit(0.0)).otherwise(F.col("part") / F.col("whole"))
    return summed.filter(F.col("occurs")).select("metric", "label", value.alias("value"))


# The file of a model folder that names its current version.
POINTER = "current"


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _read_pointer(spark: SparkSession, path: str) -> str | None:
    pointer, files = _files(spark, f"{path.rstrip('/')}/{POINTER}")
    if not files.exists(pointer):
        return None
    stream = files.open(pointer)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def _switch_pointer(spark: SparkSession, path: str, version: str) -> None:
    """Write the pointer beside itself and rename it over the earlier one: a reader finds one of the two."""
    jvm, base = spark._jvm, path.rstrip("/")
    fresh, files = _files(spark, f"{base}/_{POINTER}_{version}")
    stream = files.create(fresh, True)
    try:
        stream.write(bytearray(version.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fresh, files.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{base}/{POINTER}")), options)


def model_versions(spark: SparkSession, path: str) -> list[str]:
    """The stored versions of a model, oldest first."""
    folder, files = _files(spark, path)
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(n for n in names if n.startswith("version_"))


def save(model: PipelineModel, path: str, keep: int = 1) -> str:
    """Store the model as a new version below ``path`` and make it the current one; returns the version's folder.

    The version is written beside the others and loaded once; only then the pointer is switched, by a rename. A save
    that fails leaves the earlier model as it was. The ``keep`` versions before the new one stay for jobs that are
    loading them; older ones are removed.
    """
    spark = SparkSession.active()
    version = f"version_{time.time_ns():020d}_{uuid.uuid4().hex[:8]}"
    folder = f"{path.rstrip('/')}/{version}"
    try:
        model.write().save(folder)
        if PipelineModel.load(folder).uid != model.uid:
            raise RuntimeError(f"the model in {folder} is not the one that was written")
    except BaseException:
        remove_folder(spark, folder)
        raise
    _switch_pointer(spark, path, version)
    for old in model_versions(spark, path)[: -1 - keep]:
        remove_folder(spark, f"{path.rstrip('/')}/{old}")
    return folder


def current_folder(path: str) -> str:
    """The folder of the current version; a folder without a pointer is a plain model of an earlier release."""
    version = _read_pointer(SparkSession.active(), path)
    return f"{path.rstrip('/')}/{version}" if version else path


def load(path: str) -> PipelineModel:
    return PipelineModel.load(current_folder(path))


NODE_COLUMNS = (
    "node int, parent int, is_left boolean, depth int, is_leaf boolean, n bigint, impurity double, gain double, "
    "prediction double, label string, feature string, threshold double, left_categories array<double>, "
    "right_categories array<double>, unseen_left boolean"
)


def tree_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The fitted tree of a stored model as rows, one for each node, in the values of the features themselves.

    ``node, parent, is_left, depth, is_leaf, n, impurity, gain, prediction, label, feature, threshold,
    left_categories, right_categories, unseen_left``. A row goes left if its feature is at most ``threshold``; where
    the feature is one of categories, if it is among the left ones, and ``unseen_left`` says where a category goes
    that training did not see. A tree of depth d has at most 2^(d+1) - 1 nodes, whatever it was trained on.
    """
    folder = current_folder(path)
    stages, files = _files(spark, f"{folder}/stages")
    names = [status.getPath().getName() for status in files.listStatus(stages)]
    tree = next(name for name in names if name.startswith("3_"))  # the fourth stage
    return tree_rows(spark, PipelineModel.load(folder), spark.read.parquet(f"{folder}/stages/{tree}/data"))


def tree_rows(spark: SparkSession, model: PipelineModel, stored_nodes: DataFrame) -> DataFrame:
    """``tree_nodes`` from the rows that Spark stores for a tree."""
    names, labels = model.stages[1].getInputCols(), model.stages[0].labels
    values = {int(i): {int(at): float(v) for v, at in pairs.items()} for i, pairs in model.stages[2].categoryMaps.items()}
    nodes = {r["id"]: r for r in stored_nodes.collect()}  # bounded by the depth
    above = {child: (r["id"], child == r["leftChild"]) for r in nodes.values() for child in (r["leftChild"], r["rightChild"]) if child >= 0}
    depth: dict[int, int] = {}
    for i in sorted(nodes):  # a parent is numbered before its children
        depth[i] = depth[above[i][0]] + 1 if i in above else 0
    rows = []
    for i, r in sorted(nodes.items()):
        leaf, split = r["leftChild"] < 0, r["split"]
        at = split["featureIndex"]
        feature = None if leaf else names[at]
        threshold = left = right = unseen = None
        if not leaf and split["numCategories"] < 0:
            threshold = float(split["leftCategoriesOrThreshold"][0])
        elif not leaf:
            known, listed = values[at], {int(c) for c in split["leftCategoriesOrThreshold"]}
            left = sorted(v for index, v in known.items() if index in listed)
            right = sorted(v for index, v in known.items() if index not in listed)
            # A category that training did not see has the next index. Spark keeps the smaller side of a split and
            # sends what is not on it to the other.
            most = int(split["numCategories"])
            unseen = len(known) in listed if len(listed) <= most // 2 else len(known) not in set(range(most)) - listed
        parent, is_left = above.get(i, (None, None))
        index = int(r["prediction"])
        rows.append(
            (i, parent, is_left, depth[i], leaf, int(r["rawCount"]), float(r["impurity"]), float(r["gain"]), float(r["prediction"]),
             labels[index] if index < len(labels) else None, feature, threshold, left, right, unseen)
        )
    return spark.createDataFrame(rows, NODE_COLUMNS)


def tree_paths(nodes: DataFrame) -> DataFrame:
    """The way to each leaf in SQL: ``leaf, prediction, label, n, path``, the conditions of the path in order.

    The paths of all leaves exclude each other and cover everything, so a row has exactly one leaf.
    """
    every = {r["node"]: r for r in nodes.collect()}  # bounded by the depth

    def among(name: str, categories: Sequence[float]) -> str:
        return f"{name} in ({', '.join(f'{c!r}D' for c in categories)})" if categories else "false"

    def condition(r, left: bool) -> str:
        name = f"`{r['feature']}`"
        if r["threshold"] is not None:
            return f"{name} {'<=' if left else '>'} {r['threshold']!r}D"
        # The side where unseen categories go is the other side's complement.
        side = among(name, r["right_categories"] if r["unseen_left"] else r["left_categories"])
        return f"not ({side})" if left == r["unseen_left"] else side

    leaves = []
    for r in every.values():
        if r["is_leaf"]:
            path, at = [], r
            while at["parent"] is not None:
                path.append(condition(every[at["parent"]], at["is_left"]))
                at = every[at["parent"]]
            leaves.append((r["node"], r["prediction"], r["label"], r["n"], " and ".join(reversed(path)) or "true"))
    return nodes.sparkSession.createDataFrame(leaves, "leaf int, prediction double, label string, n bigint, path string")


def score_by_paths(df: DataFrame, paths: DataFrame, features: Sequence[str]) -> DataFrame:
    """Every row with the leaf it falls into and what that leaf says, by SQL expressions alone: no model is loaded."""
    leaves = paths.orderBy("leaf").collect()  # bounded by the depth
    numbers = df.withColumns({f"_f{i}": F.coalesce(F.col(f), F.lit(NULL_FEATURE)).cast("double") for i, f in enumerate(features)})
    leaf = F.lit(None).cast("int")
    for r in reversed(leaves):
        path = r["path"]
        for i, f in enumerate(features):
            path = path.replace(f"`{f}`", f"`_f{i}`")
        leaf = F.when(F.expr(path), F.lit(r["leaf"])).otherwise(leaf)
    at = {r["leaf"]: r for r in leaves}
    placed = numbers.withColumn("leaf", leaf).drop(*(f"_f{i}" for i in range(len(features))))

    def told(column: str) -> Column:
        out = F.lit(None).cast("double" if column == "prediction" else "string")
        for number, r in at.items():
            out = F.when(F.col("leaf") == number, F.lit(r[column])).otherwise(out)
        return out

    return placed.withColumns({PREDICTION: told("prediction"), PREDICTION_LABEL: told("label")})


def node_weights(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(feature, weight)`` from the node rows: the gain of a feature's splits by the rows they split, as shares."""
    gains = nodes.filter(~F.col("is_leaf")).groupBy("feature").agg(F.sum(F.col("gain") * F.col("n")).alias("gain"))
    names = nodes.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    total = gains.agg(F.sum("gain")).first()[0] or 0.0
    share = F.when(F.lit(total > 0), F.coalesce("gain", F.lit(0.0)) / F.lit(total or 1.0)).otherwise(F.lit(0.0))
    return names.join(gains, "feature", "left").select("feature", share.alias("weight"))
