"""Comparison of two sets of files by checksum."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countercheck.functions import values as V

#: Bytes read at a time, so a file of any size needs little memory.
CHUNK_BYTES = 1 << 20


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, relative_path, bytes`` of every file under a directory (or of
    one file). Contents are not read. Files whose names or folders start with
    ``_`` or ``.``, which Spark's own listing hides, are listed too."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", F.col("length").alias("bytes"))
    )
    hidden = spark.createDataFrame(_hidden(spark, path, pattern), "path string, bytes bigint")
    files = files.unionAll(hidden).dropDuplicates(["path"])
    root = F.lit(_bare(path).rstrip("/"))
    bare = F.regexp_replace(F.col("path"), r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    below = F.expr("substring(bare, length(root) + 2)")
    return (
        files.withColumns({"bare": bare, "root": root})
        .withColumn(
            "relative_path",
            F.when(F.col("bare") == F.col("root"), F.element_at(F.split("bare", "/"), -1)).otherwise(below),
        )
        .select("path", "relative_path", "bytes")
    )


def _hidden(spark: SparkSession, path: str, pattern: str) -> list[tuple[str, int]]:
    """Path and length of the files below a path that have a part which starts with ``_`` or ``.``."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    accepted = hadoop.GlobFilter(pattern)
    where = hadoop.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for root in system.globStatus(where) or []:
        depth = root.getPath().depth() - (0 if root.isDirectory() else 1)
        files = system.listFiles(root.getPath(), True)
        while files.hasNext():
            file = files.next()
            parts = [p for p in _bare(file.getPath().toString()).split("/") if p][depth:]
            if any(p[0] in "_." for p in parts) and accepted.accept(file.getPath()):
                found.append((file.getPath().toString(), file.getLen()))
    return found


def _bare(path: str) -> str:
    """A path without its scheme and host."""
    if "://" in path:
        rest = path.split("://", 1)[1]
        return "/" + rest.split("/", 1)[1] if "/" in rest else "/"
    return path.split(":", 1)[1] if path.startswith("file:") else path


def checksums(files: DataFrame, algorithm: str = "sha256", tasks: int | None = None) -> DataFrame:
    """Adds ``checksum`` to listed files. Files are spread over tasks and each
    is read in chunks by the task that hashes it."""
    hashlib.new(algorithm)

    def hash_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            digests = []
            for uri in batch["path"]:
                uri = re.sub("^s3[an]:", "s3:", uri)
                if uri.startswith("file:"):
                    uri = "file:///" + uri.removeprefix("file:").lstrip("/")
                system, path = fs.FileSystem.from_uri(uri)
                digest = hashlib.new(algorithm)
                with system.open_input_stream(path) as stream:
                    while chunk := stream.read(CHUNK_BYTES):
                        digest.update(chunk)
                digests.append(digest.hexdigest())
            yield batch.assign(checksum=digests)

    tasks = tasks or files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(tasks, "path").mapInPandas(
        hash_files, "path string, relative_path string, bytes bigint, checksum string"
    )


def compare_files(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row per relative path: MATCH, MISMATCH, MISSING or EXTRA in target."""
    s = source.select("relative_path", F.col("bytes").alias("source_bytes"), F.col("checksum").alias("source_checksum"))
    t = target.select("relative_path", F.col("bytes").alias("target_bytes"), F.col("checksum").alias("target_checksum"))
    status = (
        F.when(F.col("target_checksum").isNull(), "MISSING_IN_TARGET")
        .when(F.col("source_checksum").isNull(), "EXTRA_IN_TARGET")
        .when(F.col("source_checksum") == F.col("target_checksum"), "MATCH")
        .otherwise("MISMATCH")
    )
    return s.join(t, "relative_path", "full_outer").withColumn("status", status)


def file_summary(comparison: DataFrame) -> DataFrame:
    return comparison.agg(
        F.count("*").alias("files_compared"),
        F.count_if(F.col("status") != "MATCH").alias("files_failed"),
    ).withColumn("status", V.verdict(F.col("files_failed") == 0))
