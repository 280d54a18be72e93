"""One query per operator, each over whole tables: ``name -> f(spark, sf_dir)``."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.packing import UNSIGNED
from tagloom.operators import audience, bitmaps, export, features, labels, merge, model, tags
from tagloom.plans import run_bitmaps, run_merge, run_shared_tasks, run_tag_task
from tagloom.session import scratch_dir, stored
from tagloom.sources import catalog, tables
from workload import roles, tagset
from workload.roles import DAY, VIEW_PAGE

Query = Callable[[SparkSession, str], DataFrame]

DURATION = "decimal(18,2)"


def _scratch_database(spark: SparkSession) -> str:
    """A database of its own in the shared scratch folder."""
    name = f"tagloom_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_dir(spark)}'")
    return name


# --- metadata ---


def active_tag_catalog(spark, sf_dir):
    return catalog.active_tags(roles.tag_info(spark, sf_dir), roles.task_info(spark, sf_dir))


def task_rules(spark, sf_dir):
    return catalog.resolved_rules(roles.task_rules(spark, sf_dir), roles.tag_info(spark, sf_dir))


# --- tags ---


def _tag(code: str) -> Query:
    return lambda spark, sf_dir: tagset.tag_frame(spark, sf_dir, code)


def tag_rule_join(spark, sf_dir):
    """As many rules as parts, with repeated keys: the lowest rule id decides."""
    part = roles.table(spark, sf_dir, "part")
    src = part.select(F.col("p_partkey").alias("uid"), F.col("p_name").alias("query_value"))
    rules = part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("query_value"),
        F.concat_ws(" ", "p_brand", "p_type").alias("sub_tag_value"),
    )
    mapped = tags.map_rules(src, rules)
    return mapped.select(F.col("uid").cast("string").alias("uid"), "tag_value")


def tag_text_values(spark, sf_dir):
    """Text tags that look like marks of the text format, written as tab-delimited text and read back."""
    values = F.element_at(
        F.array(*map(F.lit, [r"\N", r"\\N", "tab\there", 'quo"te', "back\\slash", "", " blank ", "plain"])),
        (F.pmod("o_orderkey", F.lit(8)) + 1).cast("int"),
    )
    src = roles.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("uid"), F.when(F.pmod("o_orderkey", F.lit(11)) > 0, values).alias("query_value")
    )
    db = _scratch_database(spark)
    tables.create_tag_table(spark, f"{db}.tg_text", "3", tab_text=True)
    tables.overwrite_day(tags.compute_tag(src, None, "3"), f"{db}.tg_text", DAY)
    return tables.read_day(spark, f"{db}.tg_text", DAY)


def tag_lenient_cast(spark, sf_dir):
    """Text that is not a number, and numbers that are, as a long tag without failing."""
    src = roles.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("uid"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
        .otherwise(F.col("o_custkey").cast("string"))
        .alias("query_value"),
    )
    return tags.compute_tag(src, None, "1", strict=False)


def tag_partition_overwrite(spark, sf_dir):
    """Two days written, one of them twice, and all read back."""
    db = _scratch_database(spark)
    table = f"{db}.tg_segment"
    tables.create_tag_table(spark, table, "3", comment="segment")
    tag = tagset.tag_frame(spark, sf_dir, "TG_Segment")
    tables.overwrite_day(tagset.tag_frame(spark, sf_dir, "TG_Nation"), table, DAY)
    tables.overwrite_day(tag, table, "2024-01-30")
    tables.overwrite_day(tag, table, DAY)
    return spark.table(table)


def tag_partition_cleared(spark, sf_dir):
    """A day overwritten by an empty frame is empty, the other day stays. Stored as tab-delimited text."""
    db = _scratch_database(spark)
    table = f"{db}.tg_ordercount"
    tables.create_tag_table(spark, table, "1", tab_text=True)
    tag = tagset.tag_frame(spark, sf_dir, "TG_OrderCount")
    tables.overwrite_day(tag, table, "2024-01-30")
    tables.overwrite_day(tag, table, DAY)
    tables.overwrite_day(tag.filter(F.lit(False)), table, DAY)
    return spark.table(table)


# --- merge ---


def tall_table(spark, sf_dir):
    return tagset.tall(spark, sf_dir)


def wide_table(spark, sf_dir):
    return tagset.wide(spark, sf_dir)


def duplicate_users(spark, sf_dir):
    return merge.duplicate_users(tagset.tall(spark, sf_dir))


def merge_job(spark, sf_dir):
    """All tag tasks of a day, then the merge, through stored tables."""
    db = _run_tags_and_merge(spark, sf_dir)
    return spark.table(f"{db}.wide_tags_20240131")


def _run_tags_and_merge(spark, sf_dir) -> str:
    db = _scratch_database(spark)
    meta = tagset.metadata(spark)
    tagset.publish_sources(spark, sf_dir)
    for task_id in range(1, len(tagset.TAGS) + 1):
        run_tag_task(spark, meta, task_id, DAY, db)
    run_merge(spark, meta, DAY, db)
    return db


def export_sorted_files(spark, sf_dir):
    """The wide table exported as files sorted by user, and read back."""
    path = scratch_dir(spark)
    export.export_files(tagset.wide(spark, sf_dir), path)
    return spark.read.parquet(path)


# --- member sets ---


def _members(spark, sf_dir):
    return bitmaps.members_of_wide(tagset.wide(spark, sf_dir), tagset.CODES)


def unpivot_tags(spark, sf_dir):
    return bitmaps.unpivot_tags(tagset.wide(spark, sf_dir), tagset.CODES)


def tag_user_sets(spark, sf_dir):
    sets = bitmaps.user_sets(_members(spark, sf_dir))
    return sets.select(
        "tag_code", "tag_value", "bucket", "n_users", F.array_join("uids", ",").alias("uids")
    )


def tag_bitmap_counts(spark, sf_dir):
    return bitmaps.user_counts(bitmaps.user_chunks(_members(spark, sf_dir)))


def tag_chunk_members(spark, sf_dir):
    """Packed members unpacked again."""
    return bitmaps.chunk_users(bitmaps.user_chunks(_members(spark, sf_dir)))


def tag_native_bitmaps(spark, sf_dir):
    """Spark bitmaps, and those of all values of a tag or-ed together."""
    per_value = bitmaps.user_bitmaps(_members(spark, sf_dir))
    return per_value.groupBy("tag_code", "bucket").agg(
        F.sum("n_users").alias("n_memberships"),
        F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("n_users"),
    )


def tag_tall_bitmap_counts(spark, sf_dir):
    """Members straight from tall rows, in which a user repeats."""
    chunks = bitmaps.user_chunks(bitmaps.members_of_tall(tagset.tall(spark, sf_dir)))
    return bitmaps.user_counts(chunks)


def bitmaps_by_type(spark, sf_dir):
    chunks = bitmaps.chunks_by_type(tagset.wide(spark, sf_dir), tagset.SPECS)
    return chunks.groupBy("value_type", "tag_code", "tag_value").agg(F.sum("n_users").alias("n_users"))


def bitmap_job(spark, sf_dir):
    """The bitmap job over the stored wide table, run twice for the day."""
    db = _run_tags_and_merge(spark, sf_dir)
    meta = tagset.metadata(spark)
    run_bitmaps(spark, meta, DAY, db)
    table = run_bitmaps(spark, meta, DAY, db)
    members = tables.read_day(spark, table, DAY)
    return members.groupBy("dt", "value_type", "tag_code").agg(
        F.count_distinct("tag_value").alias("n_values"), F.sum("n_users").alias("n_users")
    )


def _unsigned_members(spark, sf_dir):
    """All tags, with users of even numbers from 2^63 on and the others down from 2^64 - 1."""
    tall = tagset.tall(spark, sf_dir)
    number, half = F.col("uid").cast("decimal(20,0)"), F.lit(Decimal(1 << 63)).cast("decimal(20,0)")
    high = F.when(F.col("uid").cast("bigint") % 2 == 0, half + number).otherwise(half + half - number)
    return bitmaps.members_of_tall(tall.withColumn("uid", high.cast("decimal(20,0)").cast("string")), ids=UNSIGNED)


def tag_unsigned_members(spark, sf_dir):
    """Unsigned ids above 2^63, packed and unpacked again."""
    users = bitmaps.chunk_users(bitmaps.user_chunks(_unsigned_members(spark, sf_dir)), UNSIGNED)
    return users.withColumn("uid", F.col("uid").cast("string"))


def tag_unsigned_counts(spark, sf_dir):
    """Users by bucket of unsigned ids, whose buckets are in the order of the ids."""
    sets = bitmaps.user_sets(_unsigned_members(spark, sf_dir), UNSIGNED)
    first, last = F.get("uids", F.lit(0)), F.element_at("uids", -1)
    return sets.select(
        "tag_code", "tag_value", "bucket", "n_users", first.cast("string").alias("first"), last.cast("string").alias("last")
    )


# Builders and makers who have views but no order that is still open, and everybody from one nation.
AUDIENCE = (
    (audience.has("TG_Segment", "builder") | audience.has("TG_Segment", "maker")) & audience.has("TG_Views")
    - audience.has("TG_Statuses", "o")
) | (audience.has("TG_Nation", "NATION_3") - audience.has("TG_Segment"))


def audience_members(spark, sf_dir):
    """An audience from several tags by set algebra on packed words, and its users."""
    chunks = bitmaps.user_chunks(_members(spark, sf_dir))
    return bitmaps.chunk_users(audience.audience_chunks(chunks, AUDIENCE))


def audience_count(spark, sf_dir):
    """The same audience from containers, counted without unpacking."""
    packed = audience.containers(bitmaps.user_chunks(_members(spark, sf_dir)))
    return audience.audience_chunks(packed, AUDIENCE).select("bucket", "n_users")


def tag_container_members(spark, sf_dir):
    """Every tag value as containers, of which some keep runs, and back to users."""
    return audience.container_users(audience.containers(bitmaps.user_chunks(_members(spark, sf_dir))))


def shared_tag_job(spark, sf_dir):
    """Three tags of one source query, written to a table each by one job, and read back."""
    db = _scratch_database(spark)
    tagset.publish_sources(spark, sf_dir)
    codes = next(group for group in tagset.SHARED if "TG_OrderCount" in group)
    ids = [tagset.CODES.index(code) + 1 for code in codes]
    names = run_shared_tasks(spark, tagset.metadata(spark), ids, DAY, db, tagset.SHARED[codes])
    slices = {code: tables.read_day(spark, name, DAY) for code, name in zip(codes, names, strict=True)}
    return merge.tall_table(slices)


# --- behaviour features ---


def item_join(spark, sf_dir):
    return features.item_visits(
        roles.page_logs(spark, sf_dir), roles.items(spark, sf_dir), item_dt=DAY, page_id=VIEW_PAGE
    )


def category_visits(spark, sf_dir):
    visited = features.category_visits(item_join(spark, sf_dir))
    return visited.withColumn("dur_time", F.col("dur_time").cast(DURATION))


def category_rank(spark, sf_dir):
    ranked = features.rank_categories(features.category_visits(item_join(spark, sf_dir)))
    return ranked.select(
        "user_id", "c1", "ct", F.col("dur_time").cast(DURATION).alias("dur_time"), F.col("rk").cast("int")
    )


def topk_categories(spark, sf_dir):
    """Five ranks instead of three, no dwell sums."""
    ranked = features.rank_categories(features.category_visits(item_join(spark, sf_dir)))
    return features.category_profile(ranked, k=5, sets={})


def category_set_dwell(spark, sf_dir):
    """Dwell sums of both default sets and of a third one."""
    ranked = features.rank_categories(features.category_visits(item_join(spark, sf_dir)))
    sets = {**features.DWELL_SETS, "other": (1, 2, 5, 7, 50)}
    return _plain(features.category_profile(ranked, k=0, sets=sets))


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(DURATION) for c in df.columns if c.endswith("_dur")})


def _features(spark, sf_dir, labelled: bool, **options) -> DataFrame:
    return features.behaviour_features(
        roles.page_logs(spark, sf_dir),
        roles.items(spark, sf_dir),
        roles.users(spark, sf_dir),
        labelled=labelled,
        item_dt=DAY,
        page_id=VIEW_PAGE,
        **options,
    )


def behaviour_features_train(spark, sf_dir):
    return _plain(_features(spark, sf_dir, True))


def behaviour_features_predict(spark, sf_dir):
    return _plain(_features(spark, sf_dir, False))


def behaviour_features_predict_with_empty(spark, sf_dir):
    """An empty label counts as missing."""
    return _plain(_features(spark, sf_dir, False, treat_empty_as_missing=True))


def behaviour_features_by_day(spark, sf_dir):
    """Bounded log days, both included."""
    return _plain(_features(spark, sf_dir, True, dt_from="2024-01-10", dt_to="2024-01-20"))


def category_codes(spark, sf_dir):
    return features.category_codes(roles.samples(spark, sf_dir))


# --- label model ---

TREE = model.BEHAVIOUR_PARAMS


def train_test_split(spark, sf_dir):
    training, held_out = model.split_by_key(roles.users(spark, sf_dir), "id", seed=7)
    return training.withColumn("part", F.lit("train")).unionByName(
        held_out.withColumn("part", F.lit("test"))
    )


def label_report(spark, sf_dir):
    """The evaluation report for a plain guess by the longer dwell."""
    guess = F.when(F.col("male_dur") >= F.col("female_dur"), "M").otherwise("F")
    guessed = _features(spark, sf_dir, True).withColumn("guess", guess)
    return model.evaluate(guessed, label="gender", prediction="guess")


def _profile(spark, sf_dir) -> DataFrame:
    """The visitors' profiles, computed once for training, report and prediction."""
    logs, items = roles.page_logs(spark, sf_dir), roles.items(spark, sf_dir)
    return stored(features.behaviour_profile(logs, items, item_dt=DAY, page_id=VIEW_PAGE))


def _trained(spark, sf_dir, profile: DataFrame | None = None):
    data = features.profile_of_users(_profile(spark, sf_dir) if profile is None else profile, roles.users(spark, sf_dir))
    return model.train(data, "gender", features.feature_columns(), TREE, seed=7)


def _predicted(spark, sf_dir) -> DataFrame:
    """Users without a label, scored by the stored and reloaded model."""
    profile, path = _profile(spark, sf_dir), scratch_dir(spark)
    model.save(_trained(spark, sf_dir, profile)[0], path)
    return model.predict(model.load(path), features.profile_of_users(profile, roles.users(spark, sf_dir), False))


def model_predictions(spark, sf_dir):
    """Labels predicted by the stored and reloaded model for users without one."""
    return _predicted(spark, sf_dir).select("user_id", "prediction_col", "prediction_origin")


def model_report(spark, sf_dir):
    fitted, held_out = _trained(spark, sf_dir)
    return model.evaluate(model.predict(fitted, held_out))


def feature_weights(spark, sf_dir):
    return model.feature_weights(spark, _trained(spark, sf_dir)[0])


def _sample_model(spark, sf_dir):
    """The sample model: category codes and a tree on them; every sample is trained on or held out."""
    coded = features.category_codes(roles.samples(spark, sf_dir))
    columns = ["hair", "height", "skirt", "age"]
    return coded, *model.train(coded, "gender", columns, model.SAMPLE_PARAMS, seed=7, key="uid")


def _stored_tree(spark, sf_dir):
    """The label model stored, its nodes as rows, and the features of users without a label."""
    profile, path = _profile(spark, sf_dir), scratch_dir(spark)
    fitted = _trained(spark, sf_dir, profile)[0]
    model.save(fitted, path)
    return fitted, model.tree_nodes(spark, path), features.profile_of_users(profile, roles.users(spark, sf_dir), False)


def model_tree_nodes(spark, sf_dir):
    return _stored_tree(spark, sf_dir)[1]


def tree_path_agreement(spark, sf_dir):
    """Whether SQL over the exported tree says of each user what the model says."""
    fitted, nodes, data = _stored_tree(spark, sf_dir)
    by_model = model.predict(fitted, data).select("user_id", "prediction_col", "prediction_origin")
    by_paths = model.score_by_paths(data, model.tree_paths(nodes), features.feature_columns())
    joined = by_model.alias("m").join(by_paths.alias("p"), "user_id")
    same = F.expr("m.prediction_col = p.prediction_col and m.prediction_origin = p.prediction_origin and p.leaf is not null")
    return joined.select("user_id", same.cast("int").alias("agrees"))


def tree_weight_agreement(spark, sf_dir):
    """Whether the weights from the exported tree are those of the model, for each feature."""
    fitted, nodes, _ = _stored_tree(spark, sf_dir)
    own = model.node_weights(nodes, features.feature_columns()).withColumnRenamed("weight", "own")
    both = own.join(model.feature_weights(spark, fitted), "feature")
    return both.select("feature", (F.abs(F.col("own") - F.col("weight")) < 1e-9).cast("int").alias("agrees"))


def sample_path_predictions(spark, sf_dir):
    """Every sample's label by SQL over the paths of the stored sample tree."""
    coded, fitted, _ = _sample_model(spark, sf_dir)
    path = scratch_dir(spark)
    model.save(fitted, path)
    paths = model.tree_paths(model.tree_nodes(spark, path))
    scored = model.score_by_paths(coded, paths, ["hair", "height", "skirt", "age"])
    return scored.select("uid", F.col("prediction_origin").alias("label"))


def sample_model_report(spark, sf_dir):
    _, fitted, held_out = _sample_model(spark, sf_dir)
    return model.evaluate(model.predict(fitted, held_out))


def sample_model_predictions(spark, sf_dir):
    """Every sample's label by the stored and reloaded sample model."""
    coded, fitted, _ = _sample_model(spark, sf_dir)
    path = scratch_dir(spark)
    model.save(fitted, path)
    predicted = model.predict(model.load(path), coded)
    return predicted.select("uid", F.col("prediction_origin").alias("label"))


def label_index(spark, sf_dir):
    """The sample model's labels by their frequency among the training rows."""
    return model.label_index(spark, _sample_model(spark, sf_dir)[1])


def feature_categories(spark, sf_dir):
    """What the sample model takes as categories."""
    found = model.feature_categories(spark, _sample_model(spark, sf_dir)[1])
    return found.select("feature", F.col("category").cast("int").alias("category"))


def predicted_label_users(spark, sf_dir):
    """Who gets a label tag, and how many times: users who declared a label, and those with features."""
    tag = predicted_label_tag(spark, sf_dir)
    return tag.groupBy("uid").agg(F.count("*").alias("n"), F.count("tag_value").alias("n_values"))


# --- label tag ---


def declared_label_tag(spark, sf_dir):
    return labels.declared_label_tag(roles.users(spark, sf_dir))


def predicted_label_tag(spark, sf_dir):
    return labels.predicted_label_tag(_predicted(spark, sf_dir), roles.users(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "active_tag_catalog": active_tag_catalog,
    "task_rules": task_rules,
    "tag_rule_mapped": _tag("TG_Segment"),
    "tag_rule_join": tag_rule_join,
    "tag_passthrough_text": _tag("TG_Nation"),
    "tag_passthrough_long": _tag("TG_OrderCount"),
    "tag_decimal": _tag("TG_OrderAmount"),
    "tag_decimal_join": _tag("TG_Quantity"),
    "tag_date": _tag("TG_LastOrder"),
    "tag_lenient_cast": tag_lenient_cast,
    "tag_text_values": tag_text_values,
    "tag_partition_overwrite": tag_partition_overwrite,
    "tag_partition_cleared": tag_partition_cleared,
    "tall_table": tall_table,
    "wide_table": wide_table,
    "duplicate_users": duplicate_users,
    "merge_job": merge_job,
    "export_sorted_files": export_sorted_files,
    "unpivot_tags": unpivot_tags,
    "tag_user_sets": tag_user_sets,
    "tag_bitmap_counts": tag_bitmap_counts,
    "tag_chunk_members": tag_chunk_members,
    "tag_native_bitmaps": tag_native_bitmaps,
    "tag_tall_bitmap_counts": tag_tall_bitmap_counts,
    "bitmaps_by_type": bitmaps_by_type,
    "bitmap_job": bitmap_job,
    "tag_unsigned_members": tag_unsigned_members,
    "tag_unsigned_counts": tag_unsigned_counts,
    "audience_members": audience_members,
    "audience_count": audience_count,
    "tag_container_members": tag_container_members,
    "shared_tag_job": shared_tag_job,
    "item_join": item_join,
    "category_visits": category_visits,
    "category_rank": category_rank,
    "topk_categories": topk_categories,
    "category_set_dwell": category_set_dwell,
    "behaviour_features_train": behaviour_features_train,
    "behaviour_features_predict": behaviour_features_predict,
    "behaviour_features_predict_with_empty": behaviour_features_predict_with_empty,
    "behaviour_features_by_day": behaviour_features_by_day,
    "category_codes": category_codes,
    "train_test_split": train_test_split,
    "label_report": label_report,
    "model_predictions": model_predictions,
    "model_report": model_report,
    "feature_weights": feature_weights,
    "model_tree_nodes": model_tree_nodes,
    "tree_path_agreement": tree_path_agreement,
    "tree_weight_agreement": tree_weight_agreement,
    "sample_path_predictions": sample_path_predictions,
    "sample_model_report": sample_model_report,
    "sample_model_predictions": sample_model_predictions,
    "label_index": label_index,
    "feature_categories": feature_categories,
    "predicted_label_users": predicted_label_users,
    "declared_label_tag": declared_label_tag,
    "predicted_label_tag": predicted_label_tag,
}
