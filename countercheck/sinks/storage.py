"""Shared storage: where intermediate tables go, who owns them, and paths that exist."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as named in ``spark.checkpoint.dir``.

    Only where a session on one machine names none, as in tests, a new
    temporary folder is set for it; on a cluster that is an error, as machines
    would each write to a folder of their own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    current = context.getCheckpointDir()
    if current is None:
        if not named and not context.master.split("[")[0] == "local":
            raise ValueError("Set spark.checkpoint.dir to a folder that all machines share.")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="countercheck-"))
        current = context.getCheckpointDir()
    return named or current


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; nothing is created yet."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder with everything in it. False if there was none."""
    system, target = _file_system(spark, path)
    return system.delete(target, True) if system.exists(target) else False


def matches(spark: SparkSession, pattern: str, parent: bool = False) -> list[str]:
    """Names of what fits a pattern, or of the folders it lies in, from one listing."""
    system, target = _file_system(spark, pattern)
    found = [status.getPath() for status in system.globStatus(target) or []]
    return [(path.getParent() if parent else path).getName() for path in found]


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, read by the driver."""
    system, target = _file_system(spark, path)
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_new_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file. False, and nothing written, if it is there already."""
    system, target = _file_system(spark, path)
    try:
        out = system.create(target, False)
    except Py4JJavaError as problem:
        if "AlreadyExists" in problem.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


class Scope:
    """The intermediate tables that were stored while it was open."""

    def __init__(self, spark: SparkSession, outer: Scope | None) -> None:
        self.spark = spark
        self.outer = outer
        self.paths: list[str] = []

    def _read_by(self, df: DataFrame) -> list[str]:
        """The scope's tables that ``df`` reads, wherever in its plan."""
        files = df.inputFiles()
        return [p for p in self.paths if any(f"/{p.rsplit('/', 1)[-1]}/" in f for f in files)]

    def keep(self, *results: DataFrame) -> None:
        """What these read outlives the scope and belongs to the one around it, or to the session."""
        for df in results:
            for path in self._read_by(df):
                self.paths.remove(path)
                if self.outer:
                    self.outer.paths.append(path)

    def drop(self, *tables: DataFrame) -> None:
        """Remove what these read, as its successors are written."""
        for df in tables:
            for path in self._read_by(df):
                self.paths.remove(path)
                remove(self.spark, path)


_OPEN: ContextVar[Scope | None] = ContextVar("open scope", default=None)


@contextmanager
def owned(spark: SparkSession) -> Iterator[Scope]:
    """Own all tables that ``stored`` writes inside; at the end those not kept are removed.

    A lost executor costs nothing that was not there before: a table is removed
    only when no plan that is still to run reads it, and its successors are
    files on shared storage themselves. Whoever passes a lazy result on has to
    ``keep`` it.
    """
    scope = Scope(spark, _OPEN.get())
    token = _OPEN.set(scope)
    try:
        yield scope
    finally:
        _OPEN.reset(token)
        for path in scope.paths:
            remove(spark, path)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends, not when the driver happens to collect garbage.

    For steps that store each result once and start from what they stored.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


FILE_ROWS = 1 << 15  # rows of a few numbers, about 1 MB


def stored(
    df: DataFrame, label: str, partition_by: str | None = None, rows: int | None = None, tasks: int = 1
) -> DataFrame:
    """The rows as a table in the shared folder, read back: later steps start from it.

    It cuts the lineage, and both sides of a later join are plain scans, which
    adaptive execution can split where a key is hot. The innermost open scope
    owns the table; without one it stays.

    With ``rows``, about how many there are at most, the table gets one file for
    each FILE_ROWS of them, or ``tasks`` files if rows take work to make, and not
    more: a round over a small table would write one for each shuffle partition,
    each at the price of a process of its own where Hadoop's file system runs
    chmod. Tables whose partitions hold more rows than that are as before.
    """
    if rows is not None:
        df = df.coalesce(max(tasks, -(-rows // FILE_ROWS)))
    path = new_folder(df.sparkSession, label)
    scope = _OPEN.get()
    if scope:
        scope.paths.append(path)
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
