"""Session helpers: settings the library relies on, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "barloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with UTC time and adaptive execution; `extra` adds or overrides settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        # Feature plans hold hundreds of expressions; recording a call site for each is slow.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **extra,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in `spark.checkpoint.dir`.

    Only a session on one machine may go without the setting (tests); it gets a folder that goes with the process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        made = tempfile.mkdtemp(prefix="barloom-shared-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _LOCAL_FOLDERS[context.applicationId] = made
    return _LOCAL_FOLDERS[context.applicationId]


_LOCAL_FOLDERS: dict[str, str] = {}


#: Spark's setting that deletes the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What the queries inside shuffle is deleted as each has ended; for those whose exchanges nothing reads again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate table once as Parquet in the shared folder and return a reader of it.

    Several branches then read the same rows instead of recomputing them, with column pruning and pushed filters, and
    the loss of an executor costs nothing. The files lie under the application's id, so that whoever runs the job can
    delete them when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/barloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
