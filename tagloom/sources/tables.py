"""Dated tables: create, read one day, overwrite one day, replace whole."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.values import check_day, column_type
from tagloom.session import remove_folder

# Fixed value: the partition that holds the open rows of a history table.
CURRENT_DAY = "9999-99-99"

# Tab-delimited text with the usual mark for NULL, so that empty text is not taken for it.
TAB_TEXT = (
    r"sep '\t', nullValue '\\N', ignoreLeadingWhiteSpace 'false', ignoreTrailingWhiteSpace 'false'"
)

# Backslashes before an N: the mark for NULL, and text that would be taken for it.
MARKED = r"^\\+N$"

OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"


def quoted(table: str) -> str:
    """Table name with every part quoted."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in table.split("."))


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_day_table(
    spark: SparkSession,
    table: str,
    columns: str,
    partitions: str = "dt string",
    location: str | None = None,
    comment: str | None = None,
    tab_text: bool = False,
) -> None:
    """Create a partitioned table unless it is there. ``tab_text`` stores tab-delimited text lines."""
    storage = f"USING csv OPTIONS ({TAB_TEXT})" if tab_text else "USING parquet"
    names = ", ".join(p.split()[0] for p in partitions.split(","))
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {quoted(table)} ({columns}, {partitions}) {storage} "
        f"PARTITIONED BY ({names})"
        + (f" LOCATION {_text(location)}" if location else "")
        + (f" COMMENT {_text(comment)}" if comment else "")
    )


def create_tag_table(
    spark: SparkSession,
    table: str,
    value_type: str,
    location: str | None = None,
    comment: str | None = None,
    tab_text: bool = False,
) -> None:
    """Create the table of one tag, ``(uid, tag_value)`` by day, unless it is there."""
    columns = f"uid string, tag_value {column_type(value_type)}"
    create_day_table(spark, table, columns, "dt string", location, comment, tab_text)


def overwrite_day(df: DataFrame, table: str, dt: str, dynamic: tuple[str, ...] = ()) -> None:
    """Replace one day of a table; other days stay, and an empty frame empties the day.

    ``dynamic`` names further partition columns whose values come from the frame. The overwrite is
    static on the day, so partitions of the day that the frame does not mention are cleared too.
    Running it twice is the same as running it once, so a lost job is simply run again.
    """
    spark = df.sparkSession
    data = [c for c in spark.table(table).columns if c != "dt" and c not in dynamic]
    if _is_text(spark, table):
        df = df.withColumns({name: _marked(_one_line(name)) for name, kind in df.dtypes if kind == "string"})
    spec = ", ".join([f"dt = '{check_day(dt)}'", *(f"`{c}`" for c in dynamic)])
    mode = spark.conf.get(OVERWRITE_MODE)
    spark.conf.set(OVERWRITE_MODE, "static")
    try:
        spark.sql(
            f"INSERT OVERWRITE TABLE {quoted(table)} PARTITION ({spec}) SELECT * FROM {{src}}",
            src=df.select(*data, *dynamic),
        )
    finally:
        spark.conf.set(OVERWRITE_MODE, mode)


def _is_text(spark: SparkSession, table: str) -> bool:
    details = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(table)}")
    provider = details.filter((F.col("col_name") == "Provider") & (F.col("data_type") == "csv"))
    return not provider.isEmpty()


def _one_line(name: str) -> Column:
    """The text column, failing on a line break: a table of text lines would tear the row apart."""
    text = F.col(f"`{name}`")
    broken = F.raise_error(F.lit(f"{name} has a line break; store this tag as parquet"))
    return F.when(text.rlike("[\n\r]"), broken.cast("string")).otherwise(text)


def _marked(text: Column) -> Column:
    """Text that looks like the mark for NULL, or like such text marked, gets one more backslash."""
    return F.when(text.rlike(MARKED), F.concat(F.lit("\\"), text)).otherwise(text)


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """All days of a table, with the text as it was written."""
    df = spark.table(table)
    if not _is_text(spark, table):
        return df
    plain = {
        name: F.when(F.col(f"`{name}`").rlike(MARKED), F.expr(f"substring(`{name}`, 2)")).otherwise(F.col(f"`{name}`"))
        for name, kind in df.dtypes
        if kind == "string" and name != "dt"
    }
    return df.withColumns(plain)


def read_day(spark: SparkSession, table: str, dt: str) -> DataFrame:
    """One day of a table; the filter prunes partitions."""
    return read_table(spark, table).filter(F.col("dt") == check_day(dt))


def read_current(spark: SparkSession, table: str) -> DataFrame:
    """The open rows of a history table."""
    return read_day(spark, table, CURRENT_DAY)


def replace_table(
    df: DataFrame, table: str, location: str | None = None, comment: str | None = None, keep: int = 1
) -> None:
    """Rebuild a whole table, with the frame's columns as they are today, and publish it in one step.

    The rows are computed into a version of their own, ``<table>_version_<time>_<random>``, with a folder of its own
    below ``location``. The name itself is a view of the current version, and replacing a view is one change of the
    catalogue: a reader sees the earlier version or the new one, and never none. A job that fails before leaves the
    earlier version published. The ``keep`` versions before the new one stay, so that readers which have started
    can end; older ones and half-written ones are dropped. A plain table of this name, as earlier releases made it,
    becomes the first version.
    """
    spark = df.sparkSession
    version = f"version_{time.time_ns():020d}_{uuid.uuid4().hex[:8]}"
    fresh = f"{table}_{version}"
    writer = df.write.mode("errorifexists").format("parquet")
    if location:
        writer = writer.option("path", f"{location.rstrip('/')}/{version}")
    try:
        writer.saveAsTable(fresh)
    except BaseException:
        _drop_version(spark, fresh, location)
        raise
    if spark.catalog.tableExists(table) and not _is_view(spark, table):
        spark.sql(f"ALTER TABLE {quoted(table)} RENAME TO {quoted(f'{table}_version_{0:020d}_{uuid.uuid4().hex[:8]}')}")
    said = f" COMMENT {_text(comment)}" if comment else ""
    spark.sql(f"CREATE OR REPLACE VIEW {quoted(table)}{said} AS SELECT * FROM {quoted(fresh)}")
    for old in table_versions(spark, table)[: -1 - keep]:
        _drop_version(spark, old, location)


def _is_view(spark: SparkSession, table: str) -> bool:
    return spark.catalog.getTable(quoted(table)).tableType == "VIEW"


def table_versions(spark: SparkSession, table: str) -> list[str]:
    """The stored versions of a published table, oldest first."""
    *database, name = table.split(".")
    place = f" IN {quoted('.'.join(database))}" if database else ""
    found = spark.sql(f"SHOW TABLES{place}").select("tableName").collect()
    names = sorted(r[0] for r in found if re.fullmatch(re.escape(name.lower()) + r"_version_\d{20}_[0-9a-f]{8}", r[0].lower()))
    return [".".join([*database, n]) for n in names]


def _drop_version(spark: SparkSession, version: str, location: str | None) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {quoted(version)}")
    if location:
        remove_folder(spark, f"{location.rstrip('/')}/version_{version.rsplit('_version_', 1)[1]}")


def publish_view(df: DataFrame, name: str) -> DataFrame:
    """Name a frame for SQL and return it."""
    df.createOrReplaceTempView(name)
    return df


def preview(df: DataFrame, rows: int = 100) -> DataFrame:
    """At most ``rows`` rows, for a look at a result."""
    return df.limit(rows)
