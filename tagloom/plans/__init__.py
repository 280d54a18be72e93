"""The daily jobs, each for one task or catalogue and one day."""

from .jobs import (
    BITMAP_TABLE,
    CONTAINER_TABLE,
    WIDE_TABLE_PREFIX,
    run_bitmaps,
    run_export,
    run_merge,
    run_prediction,
    run_sample_training,
    run_shared_tasks,
    run_tag_task,
    run_training,
    wide_table_name,
)

__all__ = [
    "BITMAP_TABLE",
    "CONTAINER_TABLE",
    "WIDE_TABLE_PREFIX",
    "run_bitmaps",
    "run_export",
    "run_merge",
    "run_prediction",
    "run_sample_training",
    "run_shared_tasks",
    "run_tag_task",
    "run_training",
    "wide_table_name",
]
