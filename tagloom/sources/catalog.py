"""Tag definitions, task definitions and value rules."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.values import column_type

TAG_SCHEMA = (
    "id bigint, tag_code string, tag_name string, tag_level bigint, parent_tag_id bigint, "
    "tag_type string, tag_value_type string, tag_value_limit bigint, tag_value_step bigint, "
    "tag_task_id bigint, tag_comment string, create_time timestamp, update_time timestamp"
)
TASK_SCHEMA = (
    "id bigint, task_name string, task_status string, task_comment string, task_time string, "
    "task_type string, exec_type string, main_class string, file_id bigint, task_args string, "
    "task_sql string, task_exec_level bigint, create_time timestamp"
)
RULE_SCHEMA = "id bigint, tag_id bigint, task_id bigint, query_value string, sub_tag_id bigint"

# A materialised tag has this level, a task that may run has this status.
TAG_LEVEL = 3
ACTIVE = "1"

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass(frozen=True)
class TagSpec:
    """What the plan builders need to know of one tag."""

    code: str
    value_type: str
    name: str = ""

    @property
    def column(self) -> str:
        """Table and column name of the tag."""
        return self.code.lower()


@dataclass(frozen=True)
class Metadata:
    """The three metadata tables as DataFrames."""

    tag_info: DataFrame
    task_info: DataFrame
    rules: DataFrame

    @classmethod
    def from_tables(cls, spark: SparkSession, database: str) -> Metadata:
        return cls(
            spark.table(f"{database}.tag_info"),
            spark.table(f"{database}.task_info"),
            spark.table(f"{database}.task_tag_rule"),
        )

    @classmethod
    def from_jdbc(cls, spark: SparkSession, url: str, properties: Mapping[str, str]) -> Metadata:
        def read(table: str) -> DataFrame:
            return spark.read.jdbc(url, table, properties=dict(properties))

        return cls(read("tag_info"), read("task_info"), read("task_tag_rule"))


def active_tags(
    tag_info: DataFrame, task_info: DataFrame, level: int = TAG_LEVEL, status: str = ACTIVE
) -> DataFrame:
    """Tags of one level whose task may run."""
    tasks = task_info.filter(F.col("task_status") == status).select(F.col("id").alias("_task"))
    tags = tag_info.filter(F.col("tag_level") == level)
    return tags.join(tasks, tags["tag_task_id"] == tasks["_task"]).drop("_task")


def tag_of_task(tag_info: DataFrame, task_id: int) -> Row | None:
    """The tag a task computes, None when it computes none; two tags of one task are an error."""
    rows = tag_info.filter(F.col("tag_task_id") == task_id).orderBy("id").take(2)
    if len(rows) > 1:
        raise ValueError(f"task {task_id} computes more than one tag")
    return rows[0] if rows else None


def task_by_id(task_info: DataFrame, task_id: int) -> Row:
    rows = task_info.filter(F.col("id") == task_id).take(1)
    if not rows:
        raise LookupError(f"no task with id {task_id}")
    return rows[0]


def resolved_rules(rules: DataFrame, tag_info: DataFrame) -> DataFrame:
    """Every rule with the name of its sub-tag, which is the value the rule maps to."""
    names = tag_info.select(F.col("id").alias("_sub"), F.col("tag_name").alias("sub_tag_value"))
    return rules.join(names, rules["sub_tag_id"] == names["_sub"]).select(
        rules["id"],
        rules["tag_id"],
        rules["task_id"],
        rules["query_value"],
        rules["sub_tag_id"],
        "sub_tag_value",
    )


def rules_for(rules: DataFrame, tag_info: DataFrame, task_id: int) -> DataFrame:
    """Rules of one task: ``(id, query_value, sub_tag_value)``. The id decides between equal keys."""
    mine = rules.filter(F.col("task_id") == task_id)
    return resolved_rules(mine, tag_info).select("id", "query_value", "sub_tag_value")


def tag_specs(active: DataFrame, most: int | None = None) -> list[TagSpec]:
    """The catalogue as plan-time values, checked before any column is built from it.

    A wide table has one column per tag, so the catalogue is needed to plan it. A caller may say how many
    tags there are at ``most``; a longer catalogue is then an error and never cut short.
    """
    rows = active.select("id", "tag_code", "tag_value_type", "tag_name").orderBy("id").collect()
    if most is not None and len(rows) > most:
        raise ValueError(f"more than {most} active tags")
    specs = [TagSpec(r["tag_code"], r["tag_value_type"], r["tag_name"] or "") for r in rows]
    check_specs(specs)
    return specs


def check_specs(specs: list[TagSpec]) -> None:
    if not specs:
        raise ValueError("the catalogue has no active tag")
    seen: set[str] = set()
    for spec in specs:
        column_type(spec.value_type)
        if not _IDENTIFIER.fullmatch(spec.code or ""):
            raise ValueError(f"tag code {spec.code!r} cannot name a table")
        if spec.column == "uid" or spec.column in seen:
            raise ValueError(f"tag code {spec.code!r} is taken (codes are compared without case)")
        seen.add(spec.column)
