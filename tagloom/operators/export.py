"""Export of the wide table to a JDBC store or to sorted files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# Rows per batch, write connections and isolation of the export.
BATCH_ROWS = 100
CONNECTIONS = 4
ISOLATION = "NONE"


def jdbc_options(
    batchsize: int = BATCH_ROWS,
    partitions: int = CONNECTIONS,
    isolation: str = ISOLATION,
    driver: str | None = None,
    create_options: str | None = None,
    column_types: str | None = None,
) -> dict[str, str]:
    """Writer options of an export. ``create_options`` follows the target's CREATE TABLE."""
    options = {
        "batchsize": str(batchsize),
        "numPartitions": str(partitions),
        "isolationLevel": isolation,
        "driver": driver,
        "createTableOptions": create_options,
        "createTableColumnTypes": column_types,
    }
    return {k: v for k, v in options.items() if v is not None}


def export_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    batchsize: int = BATCH_ROWS,
    partitions: int = CONNECTIONS,
    isolation: str = ISOLATION,
    driver: str | None = None,
    create_options: str | None = None,
    column_types: str | None = None,
    properties: Mapping[str, str] | None = None,
    order_by: str = "uid",
    verify: bool = True,
) -> None:
    """Recreate the target table and write the frame to it.

    The frame is cut into one range of ``order_by`` per connection, each sorted. The shuffle keeps the
    stage before it parallel, which merely limiting the writer's partitions would not.

    Without transactions a task that is retried after a lost executor may write rows twice. So the
    target's row count is compared with the frame's at the end, and a mismatch fails the export: it
    replaces the target, hence running it again is safe.
    """
    spark = df.sparkSession
    options = jdbc_options(batchsize, partitions, isolation, driver, create_options, column_types)
    ordered = df.repartitionByRange(partitions, order_by).sortWithinPartitions(order_by)
    ordered.write.mode("overwrite").options(**options).jdbc(url, table, properties=dict(properties or {}))
    if verify:
        _check_rows(spark, df, url, table, driver, properties)


def _check_rows(
    spark: SparkSession,
    df: DataFrame,
    url: str,
    table: str,
    driver: str | None,
    properties: Mapping[str, str] | None,
) -> None:
    extra = {**(properties or {}), **({"driver": driver} if driver else {})}
    written = spark.read.jdbc(url, table, properties=extra).count()
    expected = df.count()
    if written != expected:
        raise RuntimeError(f"{table} has {written} rows after the export of {expected}; run it again")


def export_files(df: DataFrame, path: str, order_by: str = "uid") -> None:
    """Write parquet files that are sorted and do not overlap in ``order_by``, replacing what is there."""
    df.repartitionByRange(order_by).sortWithinPartitions(order_by).write.mode("overwrite").parquet(path)
