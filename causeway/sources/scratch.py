"""Folders for intermediate files that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []
#: Folders made within the innermost `passing`.
_PASSING: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("passing", default=None)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir.

    A session that names none uses its warehouse folder, which its tasks share as well.
    The folder is deleted when the program ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{shared.rstrip('/')}/run-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(release)
    _MADE.append((spark, folder))
    passing = _PASSING.get()
    if passing is not None:
        passing.append((spark, folder))
    return folder


def release() -> None:
    """Delete the folders made so far; frames that read them can't be used any more."""
    while _MADE:
        _delete(*_MADE.pop())


def _delete(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a shared folder that nothing will read again."""
    _delete(spark, folder)
    _MADE[:] = [made for made in _MADE if made[1] != folder]


@contextlib.contextmanager
def passing() -> Iterator[list[tuple[SparkSession, str]]]:
    """Folders that are made in here and left in the list are deleted at the end."""
    mine: list[tuple[SparkSession, str]] = []
    token = _PASSING.set(mine)
    try:
        yield mine
    finally:
        _PASSING.reset(token)
        for made in mine:
            discard(*made)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What jobs in here shuffle is deleted as soon as each has ended.

    Else shuffle files stay until the driver happens to collect garbage, which on large
    tables may be never. Only for jobs that write: nothing reads their shuffles again.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def staged(df: DataFrame) -> DataFrame:
    """The rows, written once to a shared folder and read from there.

    This cuts lineage, survives the loss of executors and fixes what depends on partitions.
    """
    folder = shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def settled(work: Callable[[], DataFrame]) -> DataFrame:
    """What ``work`` returns, staged; folders that it made on its way are deleted then."""
    with passing() as made:
        kept = staged(work())
        last = made.pop()
    outer = _PASSING.get()
    if outer is not None:
        outer.append(last)
    return kept
