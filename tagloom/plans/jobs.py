"""Daily jobs over the session catalog. Each one replaces what it wrote before for the same day."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.packing import SIGNED, IdSpace
from tagloom.functions.values import TEXT, check_day, day_suffix
from tagloom.operators import audience, bitmaps, export, features, labels, merge, model, tags
from tagloom.session import scope, stored
from tagloom.sources import catalog, tables

WIDE_TABLE_PREFIX = "wide_tags"
BITMAP_TABLE = "tag_members"

CONTAINER_TABLE = "tag_containers"

CHUNK_COLUMNS = (
    "tag_code string, tag_value string, bucket bigint, n_users bigint, "
    "words array<struct<word: int, bits: bigint>>"
)
CONTAINER_COLUMNS = f"{CHUNK_COLUMNS}, runs array<struct<first: int, last: int>>"


def wide_table_name(dt: str, prefix: str = WIDE_TABLE_PREFIX) -> str:
    return f"{prefix}_{day_suffix(dt)}"


def _place(base: str | None, database: str, table: str) -> str | None:
    return f"{base.rstrip('/')}/{database}/{table}" if base else None


def run_tag_task(
    spark: SparkSession,
    meta: catalog.Metadata,
    task_id: int,
    dt: str,
    database: str,
    warehouse: str | None = None,
    base: str | None = None,
    source: tags.TaskSource | None = None,
    strict: bool = True,
    tab_text: bool = False,
) -> str:
    """Compute the tag of one task for one day into ``database.<tag code>``; returns the table name.

    The task's SQL runs with ``warehouse`` as the current database. ``source`` replaces that SQL.
    """
    check_day(dt)
    tag = catalog.tag_of_task(meta.tag_info, task_id)
    if tag is None:
        raise LookupError(f"task {task_id} computes no tag")
    task = catalog.task_by_id(meta.task_info, task_id)
    spec = catalog.TagSpec(tag["tag_code"], tag["tag_value_type"], tag["tag_name"] or "")
    catalog.check_specs([spec])
    rules = catalog.rules_for(meta.rules, meta.tag_info, task_id)

    table = f"{database}.{spec.column}"
    tables.create_tag_table(
        spark, table, spec.value_type, _place(base, database, spec.column), spec.name or None, tab_text
    )
    before = spark.catalog.currentDatabase()
    if warehouse:
        spark.catalog.setCurrentDatabase(warehouse)
    try:
        src = tags.task_query(spark, source or task["task_sql"], dt)
        tables.overwrite_day(tags.compute_tag(src, rules, spec.value_type, strict), table, dt)
    finally:
        spark.catalog.setCurrentDatabase(before)
    return table


def run_shared_tasks(
    spark: SparkSession,
    meta: catalog.Metadata,
    task_ids: Sequence[int],
    dt: str,
    database: str,
    source: tags.TaskSource,
    warehouse: str | None = None,
    base: str | None = None,
    strict: bool = True,
    tab_text: bool = False,
) -> list[str]:
    """Compute the tags of several tasks from one source query for one day; returns the table names.

    The query yields ``uid`` and a column for each tag code. It is run once, into the shared scratch folder; each
    tag's table takes its column from there. A user is a row of each of the tables.
    """
    check_day(dt)
    specs, shared = [], []
    for task_id in task_ids:
        tag = catalog.tag_of_task(meta.tag_info, task_id)
        if tag is None:
            raise LookupError(f"task {task_id} computes no tag")
        specs.append(catalog.TagSpec(tag["tag_code"], tag["tag_value_type"], tag["tag_name"] or ""))
        rules = catalog.rules_for(meta.rules, meta.tag_info, task_id)
        shared.append(tags.SharedTag(tag["tag_code"], tag["tag_value_type"], None if rules.isEmpty() else rules))
    catalog.check_specs(specs)

    names = [f"{database}.{spec.column}" for spec in specs]
    before = spark.catalog.currentDatabase()
    with scope(spark):
        if warehouse:
            spark.catalog.setCurrentDatabase(warehouse)
        try:
            src = tags.shared_query(spark, source, dt, [spec.column for spec in specs])
            values = stored(tags.typed_columns(src, shared, strict))
        finally:
            spark.catalog.setCurrentDatabase(before)
        for spec, name in zip(specs, names, strict=True):
            place = _place(base, database, spec.column)
            tables.create_tag_table(spark, name, spec.value_type, place, spec.name or None, tab_text)
            tables.overwrite_day(values.select("uid", F.col(f"`{spec.column}`").alias("tag_value")), name, dt)
    return names


def run_merge(
    spark: SparkSession,
    meta: catalog.Metadata,
    dt: str,
    database: str,
    base: str | None = None,
    prefix: str = WIDE_TABLE_PREFIX,
    one_value: bool | Collection[str] = False,
) -> str:
    """Merge the day's slices of all active tags into the day's wide table; returns its name."""
    specs = catalog.tag_specs(catalog.active_tags(meta.tag_info, meta.task_info))
    slices = {s.column: tables.read_day(spark, f"{database}.{s.column}", dt) for s in specs}
    # Rows of a tag keep its code as a literal, so the two ways of the merge read each table once.
    wide = merge.wide_table(merge.tall_table(slices), list(slices), one_value)
    name = wide_table_name(dt, prefix)
    tables.replace_table(wide, f"{database}.{name}", _place(base, database, name))
    return f"{database}.{name}"


def run_export(
    spark: SparkSession,
    dt: str,
    database: str,
    url: str,
    prefix: str = WIDE_TABLE_PREFIX,
    properties: Mapping[str, str] | None = None,
    **options: object,
) -> None:
    """Export the day's wide table to a JDBC store, into a table of the same name."""
    name = wide_table_name(dt, prefix)
    export.export_jdbc(spark.table(f"{database}.{name}"), url, name, properties=properties, **options)


def run_bitmaps(
    spark: SparkSession,
    meta: catalog.Metadata,
    dt: str,
    database: str,
    base: str | None = None,
    prefix: str = WIDE_TABLE_PREFIX,
    table: str | None = None,
    ids: IdSpace = SIGNED,
    with_runs: bool = False,
) -> str:
    """Member chunks of the day, in one table partitioned by day and value type; returns its name.

    One pass writes all types. The overwrite is static on the day, so a type that has no tag any more
    loses its partition. ``ids`` says how uids are read; ``with_runs`` writes containers, into a table of their own.
    """
    specs = catalog.tag_specs(catalog.active_tags(meta.tag_info, meta.task_info))
    wide = spark.table(f"{database}.{wide_table_name(dt, prefix)}")
    table = table or (CONTAINER_TABLE if with_runs else BITMAP_TABLE)
    name = f"{database}.{table}"
    columns = CONTAINER_COLUMNS if with_runs else CHUNK_COLUMNS
    tables.create_day_table(spark, name, columns, "dt string, value_type string", _place(base, database, table))
    chunks = bitmaps.chunks_by_type(wide, specs, ids)
    tables.overwrite_day(audience.containers(chunks) if with_runs else chunks, name, dt, dynamic=("value_type",))
    return name


def run_training(
    logs: DataFrame,
    items: DataFrame,
    users: DataFrame,
    model_path: str,
    dt_from: str,
    dt_to: str | None = None,
    params: model.TreeParams = model.BEHAVIOUR_PARAMS,
    seed: int = 0,
    columns: Sequence[str] | None = None,
    k: int = features.TOP_CATEGORIES,
    sets: Mapping[str, Sequence[int]] = features.DWELL_SETS,
    **options: object,
) -> tuple[PipelineModel, DataFrame]:
    """Train the label model, store it, and return it with the report on the held-out users.

    Features cover the log days ``dt_from`` to ``dt_to``, or ``dt_from`` alone; ``options`` are those of
    ``behaviour_features``. The tree and its weights are had from the model.
    """
    # One pass over the logs: training, the held-out report and each tree level read the stored rows.
    data = features.behaviour_features(logs, items, users, dt_from, dt_to, True, k, sets, **options)
    data = stored(data)
    fitted, held_out = model.train(data, "gender", columns or features.feature_columns(k, sets), params, seed)
    model.save(fitted, model_path)
    return fitted, model.evaluate(model.predict(fitted, held_out))


def run_sample_training(
    samples: DataFrame,
    model_path: str,
    columns: Sequence[str] = ("hair", "height", "skirt", "age"),
    label: str = "gender",
    key: str = "uid",
    codes: Mapping[str, Mapping[object, object]] = features.SAMPLE_CODES,
    params: model.TreeParams = model.SAMPLE_PARAMS,
    seed: int = 0,
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Train the sample model on coded categories and store it; returns it, its report and the scored held-out rows.

    A category without a code is NULL and counts as one of its own. Every sample is trained on or held out.
    """
    coded = stored(features.category_codes(samples.select(key, label, *columns), codes))
    fitted, held_out = model.train(coded, label, list(columns), params, seed, key)
    model.save(fitted, model_path)
    predicted = model.predict(fitted, held_out)
    return fitted, model.evaluate(predicted), predicted.select(key, label, *columns, model.PREDICTION_LABEL)


def run_prediction(
    spark: SparkSession,
    logs: DataFrame,
    items: DataFrame,
    users: DataFrame,
    model_path: str,
    dt: str,
    table: str,
    dt_from: str | None = None,
    location: str | None = None,
    treat_empty_as_missing: bool = False,
    **options: object,
) -> None:
    """Write the day's label tag: the model's word for users without a label, else their own.

    Features cover the log days ``dt_from`` to ``dt``, or ``dt`` alone; ``options`` are those of
    ``behaviour_features`` and must be the ones of the training.
    """
    data = features.behaviour_features(
        logs, items, users, dt_from or dt, dt, False, treat_empty_as_missing=treat_empty_as_missing, **options
    )
    predicted = model.predict(model.load(model_path), data)
    tag = labels.predicted_label_tag(predicted, users, treat_empty_as_missing=treat_empty_as_missing)
    tables.create_tag_table(spark, table, TEXT, location)
    tables.overwrite_day(tag, table, dt)
