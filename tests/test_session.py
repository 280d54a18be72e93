"""Scratch tables: who owns them, and what is left of them."""

from pathlib import Path

import pytest
from frames import rows
from pyspark.sql import functions as F

from tagloom.session import SHUFFLE_CLEANUP_KEY, scope, stored


def folders(spark):
    return {p.name for p in Path(spark.conf.get("spark.checkpoint.dir")).glob("tagloom-*")}


def bytes_in(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_a_scope_drops_what_it_owns(spark):
    before = folders(spark)
    with scope(spark) as own:
        first = stored(spark.range(1000))
        second = stored(first.filter("id % 2 = 0"))
        result = own.keep(second.select((F.col("id") + 1).alias("x")))
        assert len(folders(spark) - before) == 3
    (left,) = folders(spark) - before
    assert result.count() == 500 and result.inputFiles()[0].split("/")[-2] == left


def test_scopes_within_scopes(spark):
    before = folders(spark)
    with scope(spark) as outer:
        with scope(spark) as inner:
            stored(spark.range(10))
            middle = inner.keep(spark.range(5))
        assert len(folders(spark) - before) == 1 and middle.count() == 5
        last = outer.keep(middle)
    assert len(folders(spark) - before) == 1 and rows(last) == [(i,) for i in range(5)]


def test_a_failing_scope_leaves_nothing(spark):
    before = folders(spark)
    with pytest.raises(Exception, match="broken"), scope(spark):
        stored(spark.range(10))
        stored(spark.sql("select raise_error('broken') as x"))
    assert folders(spark) == before


def test_without_a_scope_tables_stay(spark):
    before = folders(spark)
    assert stored(spark.range(3)).count() == 3 and len(folders(spark) - before) == 1


def test_the_disk_at_the_end_is_the_output(spark):
    """Neither tables nor shuffle files of what was computed on the way are left."""
    spark.conf.unset(SHUFFLE_CLEANUP_KEY)
    place = spark._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    local = [Path(str(place[i].getAbsolutePath())) for i in range(len(place))]
    shuffles = lambda: {p.name for d in local for p in d.rglob("shuffle_*")}
    before, files = folders(spark), shuffles()
    with scope(spark) as own:
        big = stored(spark.range(200_000).withColumn("k", F.xxhash64("id")).repartition(4, "k"))
        sums = stored(big.groupBy((F.col("k") % 1000).alias("k")).agg(F.sum("id").alias("s")))
        result = own.keep(sums.join(big.groupBy((F.col("k") % 1000).alias("k")).count(), "k"))
    (left,) = folders(spark) - before
    base = Path(spark.conf.get("spark.checkpoint.dir"))
    assert bytes_in(base / left) == sum(bytes_in(base / n) for n in folders(spark) - before)
    assert shuffles() <= files
    assert result.count() > 1000
    assert spark.conf.get(SHUFFLE_CLEANUP_KEY, None) in (None, "false")
