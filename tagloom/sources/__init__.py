"""Metadata (tags, tasks, rules) and dated tables."""

from .catalog import (
    RULE_SCHEMA,
    TAG_SCHEMA,
    TASK_SCHEMA,
    Metadata,
    TagSpec,
    active_tags,
    resolved_rules,
    rules_for,
    tag_of_task,
    tag_specs,
    task_by_id,
)
from .tables import (
    CURRENT_DAY,
    create_tag_table,
    overwrite_day,
    publish_view,
    read_current,
    read_day,
    replace_table,
)

__all__ = [
    "CURRENT_DAY",
    "RULE_SCHEMA",
    "TAG_SCHEMA",
    "TASK_SCHEMA",
    "Metadata",
    "TagSpec",
    "active_tags",
    "create_tag_table",
    "overwrite_day",
    "publish_view",
    "read_current",
    "read_day",
    "replace_table",
    "resolved_rules",
    "rules_for",
    "tag_of_task",
    "tag_specs",
    "task_by_id",
]
