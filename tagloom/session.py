"""Session helpers: a tuned builder for stand-alone runs, and the shared scratch folder."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Spark removes the shuffle files of a query when it ends, not when the driver's memory is next collected.
SHUFFLE_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def spark_session(
    app: str = "tagloom", master: str | None = None, hive: bool = False, **conf: str
) -> SparkSession:
    """A session with adaptive execution on; on a cluster, leave ``master`` to spark-submit.

    With ``hive`` tables live in the Hive catalogue that the cluster's configuration names, where the next job
    finds them. Spark's own catalogue ends with the process.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.parquet.compression.codec", "zstd")
    )
    if hive:
        builder = builder.enableHiveSupport()
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    The folder must be visible to every executor, so the session's own setting is used. Only a local
    session may go without one: there the machine's temporary folder is shared by definition.
    """
    context = spark.sparkContext
    base = spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tagloom-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tagloom-{uuid.uuid4().hex}"


class Scope:
    """Owns the tables that ``stored`` writes while it is the innermost scope, and drops them at its end."""

    def __init__(self, spark: SparkSession, outer: Scope | None):
        self.spark, self.outer, self.folders = spark, outer, []

    def keep(self, df: DataFrame) -> DataFrame:
        """The frame stored so that it outlives this scope: the next outer scope owns it, if there is one."""
        return _stored(df, self.outer)

    def drop(self) -> None:
        for folder in self.folders:
            remove_folder(self.spark, folder)
        self.folders = []


_SCOPE: contextvars.ContextVar[Scope | None] = contextvars.ContextVar("tagloom_scope", default=None)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Tables stored inside are dropped at the end; what is needed afterwards goes through ``keep``.

    Nothing lazy that reads such a table may leave the scope. The kept result is a finished table in the shared
    folder, so a lost executor needs none of the tables it was made from.
    """
    own = Scope(spark, _SCOPE.get())
    token = _SCOPE.set(own)
    try:
        yield own
    finally:
        _SCOPE.reset(token)
        own.drop()


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """The frame written to the shared scratch folder and read back.

    For results that are read several times: they are computed once, and a lost executor costs a read. Inside a
    ``scope`` the table is dropped with it.
    """
    return _stored(df, _SCOPE.get())


def _stored(df: DataFrame, owner: Scope | None) -> DataFrame:
    spark = df.sparkSession
    path = scratch_dir(spark)
    if owner:
        owner.folders.append(path)
    with cleaned_shuffles(spark):
        df.write.parquet(path)
    # The schema is known; reading it from the files would cost a job.
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files behind."""
    before = spark.conf.get(SHUFFLE_CLEANUP_KEY, None)
    spark.conf.set(SHUFFLE_CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP_KEY)
        else:
            spark.conf.set(SHUFFLE_CLEANUP_KEY, before)
