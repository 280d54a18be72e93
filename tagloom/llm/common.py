"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import scope, stored

__all__ = ["bounded_batches", "by_value", "fold", "give_back", "kept", "lean", "rank_within", "scope", "stored", "table"]

# ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_value(module: str) -> None:
    """Ship the module's functions inside the tasks, so that executors need no copy of the library."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python by ``rows`` at a time at most: ten thousand long texts are too much for a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def give_back() -> None:
    """Hands the free memory of this worker back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def _worker_state() -> dict:
    return sys.modules.setdefault("tagloom_worker_state", types.ModuleType("tagloom_worker_state")).__dict__


def lean(run: Callable, keeps: Collection[str] = ()) -> Callable:
    """The batch function ``run``, whose worker gives its free memory back at the end: it stays for other tasks.

    What other operators have ``kept`` in the worker, a vocabulary with its memory of words say, goes before the first batch.
    """

    def wrapped(batches: Iterator) -> Iterator:
        state = _worker_state()
        others = [name for name in state if not name.startswith("__") and name not in keeps]
        for name in others:
            del state[name]
        if others:
            give_back()
        yield from run(batches)
        give_back()

    return wrapped


def kept(name: str, make: Callable):
    """``make()`` once for each Python worker process: tokenizers and caches outlive a task, until another operator's begins."""
    state = _worker_state()
    if name not in state:
        state[name] = make()
    return state[name]


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def rank_within(rows: DataFrame, keys: list[str], order: list[str], out: str, parts: int = 1024) -> DataFrame:
    """A gapless number from 0 for each row among the rows of its keys.

    Rows of a key are dealt to ``parts`` slices by a hash of the ordering columns. Slices are counted first and
    numbered alone, so that no task holds more than a slice, however many rows a key has.
    """
    from pyspark.sql import Window

    cut = rows.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = cut.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        cut.join(starts, [*keys, "_slice"])
        .withColumn(out, F.col("_start") + F.row_number().over(own) - 1)
        .drop("_slice", "_start")
    )


by_value(__name__)
