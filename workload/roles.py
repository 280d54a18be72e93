"""The provided tables in the roles that the operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.sources.tables import CURRENT_DAY

DAY = "2024-01-31"
VIEW_PAGE = "view"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page-view facts. The page is the plain event type, so a filter on it reaches the scan."""
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.col("event_type").alias("page_id"),
        F.get_json_object("props", "$.k").alias("page_item"),
        F.lit("sku_id").alias("page_item_type"),
        F.col("value").cast("decimal(16,2)").alias("during_time"),
        F.date_format("ts", "yyyy-MM-dd").alias("dt"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item snapshot with its first-level category."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_size").cast("string").alias("category1_id"),
        F.lit(DAY).alias("dt"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current users; the label is present, empty or NULL depending on the segment."""
    segment = F.col("c_mktsegment")
    gender = (
        F.when(segment.isin("BUILDING", "MACHINERY"), "M")
        .when(segment == "HOUSEHOLD", "F")
        .when(segment == "FURNITURE", "")
    )
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), gender.alias("gender"), F.lit(CURRENT_DAY).alias("dt")
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample table with text categories; some categories have no code."""
    kind, size = F.col("p_type"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("uid"),
        F.when(kind == "SMALL", "长发")
        .when(kind == "MEDIUM", "短发")
        .when(kind == "LARGE", "板寸")
        .when(kind == "PROMO", "其他")
        .alias("hair"),
        F.col("p_retailprice").alias("height"),
        F.when(size % 2 == 0, "是").otherwise("否").alias("skirt"),
        F.when(size < 15, "00后").when(size < 30, "90后").when(size < 45, "80后").otherwise("70后").alias("age"),
        F.when((size % 2 == 0) & (kind != "LARGE"), "F").otherwise("M").alias("gender"),
    )


def tag_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag catalogue as large as ``part``."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("TAG_"), F.col("p_partkey").cast("string")).alias("tag_code"),
        F.col("p_name").alias("tag_name"),
        (F.col("p_partkey") % 2 + 3).alias("tag_level"),
        F.floor(F.col("p_partkey") / 2).alias("parent_tag_id"),
        F.col("p_type").alias("tag_type"),
        (F.col("p_size") % 4 + 1).cast("string").alias("tag_value_type"),
        F.col("p_size").cast("bigint").alias("tag_task_id"),
    )


def task_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks, one per supplier; those with a negative balance may not run."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("task_name"),
        F.when(F.col("s_acctbal") > 0, "1").otherwise("0").alias("task_status"),
    )


def task_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value rules, one per line item."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_partkey").alias("tag_id"),
        F.col("l_suppkey").alias("task_id"),
        F.col("l_returnflag").alias("query_value"),
        F.col("l_partkey").alias("sub_tag_id"),
    )
