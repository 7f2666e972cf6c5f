"""Reading a source into a DataFrame.

Paths may use any scheme the cluster's Hadoop file systems know (``s3a://``,
``abfss://``, ``wasbs://``, ``gs://``, ``hdfs://``); files are split and read
by the executors.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countercheck.functions.names import ref, require_columns
from countercheck.sources.flatten import flatten

# File extensions and the format each stands for.
EXTENSIONS = {
    ".csv": "csv",
    ".txt": "csv",
    ".xml": "xml",
    ".json": "json",
    ".jsonl": "json",
    ".ndjson": "json",
    ".parquet": "parquet",
    ".pq": "parquet",
    ".avro": "avro",
}

# CSV text that is read as missing.
NA_VALUES = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# JDBC address and driver class per database, from the vendors'
# public driver documentation.
JDBC = {
    "sqlite": ("jdbc:sqlite:{database}", "org.sqlite.JDBC"),
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver"),
    "greenplum": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver"),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver"),
    "mariadb": ("jdbc:mariadb://{host}:{port}/{database}", "org.mariadb.jdbc.Driver"),
    "sqlserver": (
        "jdbc:sqlserver://{host}:{port};databaseName={database}",
        "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    ),
    "synapse": (
        "jdbc:sqlserver://{host}:{port};databaseName={database}",
        "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    ),
    "azure_sql": (
        "jdbc:sqlserver://{host}:{port};databaseName={database}",
        "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    ),
    "oracle": ("jdbc:oracle:thin:@//{host}:{port}/{database}", "oracle.jdbc.OracleDriver"),
    "snowflake": (
        "jdbc:snowflake://{host}:{port}/?db={database}",
        "net.snowflake.client.jdbc.SnowflakeDriver",
    ),
    "db2": ("jdbc:db2://{host}:{port}/{database}", "com.ibm.db2.jcc.DB2Driver"),
    "teradata": (
        "jdbc:teradata://{host}/DATABASE={database},DBS_PORT={port}",
        "com.teradata.jdbc.TeraDriver",
    ),
    "redshift": (
        "jdbc:redshift://{host}:{port}/{database}",
        "com.amazon.redshift.jdbc42.Driver",
    ),
    "databricks": (
        "jdbc:databricks://{host}:{port}/{database}",
        "com.databricks.client.jdbc.Driver",
    ),
    "hive": ("jdbc:hive2://{host}:{port}/{database}", "org.apache.hive.jdbc.HiveDriver"),
    "spark": ("jdbc:hive2://{host}:{port}/{database}", "org.apache.hive.jdbc.HiveDriver"),
    "hana": (
        "jdbc:sap://{host}:{port}/?databaseName={database}",
        "com.sap.db.jdbc.Driver",
    ),
    "informix": (
        "jdbc:informix-sqli://{host}:{port}/{database}",
        "com.informix.jdbc.IfxDriver",
    ),
}


class SourceError(ValueError):
    """A source cannot be read as described."""


@dataclass(frozen=True)
class Source:
    """What to read. One of ``path``, ``table`` and ``query`` is needed.

    ``format`` is a file format, "table" (a table of the session catalog),
    "jdbc", a database named in ``JDBC``, or "mongodb"; files without one go by
    their extension. ``options`` are passed to Spark's reader as they are.
    ``row_limit`` is off unless set.
    """

    format: str | None = None
    path: str | None = None
    table: str | None = None
    query: str | None = None
    columns: Sequence[str] = ()
    row_limit: int | None = None
    schema: str | None = None
    na_values: Sequence[str] = NA_VALUES
    options: Mapping[str, str] = field(default_factory=dict)


def format_of(source: Source) -> str:
    if source.format:
        return source.format.lower()
    if source.path:
        suffix = PurePosixPath(source.path.rstrip("/")).suffix.lower()
        if suffix in EXTENSIONS:
            return EXTENSIONS[suffix]
        raise SourceError(f"Cannot tell the format of '{source.path}'.")
    if source.table or source.query:
        return "table"
    raise SourceError("A path, a table or a query is needed.")


def load(spark: SparkSession, source: Source) -> DataFrame:
    """The source as a DataFrame, with the columns and row limit asked for."""
    kind = format_of(source)
    if kind in ("csv", "json", "xml", "parquet", "avro"):
        if not source.path:
            raise SourceError(f"A {kind} source needs a path.")
        df = _read_files(spark, kind, source)
    elif kind == "table":
        df = spark.sql(source.query) if source.query else spark.table(_table(source))
    elif kind == "jdbc" or kind in JDBC:
        df = _read_jdbc(spark, kind, source)
    elif kind == "mongodb":
        df = _read_mongodb(spark, source)
    else:
        raise SourceError(f"Unsupported format: '{kind}'.")
    if source.columns:
        df = df.select([ref(c) for c in require_columns(source.columns, df.columns, "Column(s)")])
    return df.limit(source.row_limit) if source.row_limit is not None else df


def _table(source: Source) -> str:
    if not source.table:
        raise SourceError("A SQL query or table name is required.")
    return source.table


def _read_files(spark: SparkSession, kind: str, source: Source) -> DataFrame:
    options = dict(source.options)
    if kind == "csv":
        return _read_csv(spark, source, options)
    reader = spark.read.options(**options)
    if source.schema:
        reader = reader.schema(source.schema)
    if kind == "json":
        # One record per line unless the option multiLine says otherwise; a
        # record that can't be read is an error.
        return flatten(reader.options(**{"mode": "FAILFAST"} | options).json(source.path))
    if kind == "xml":
        tag = re.search(r"([^/@\[\]*.:]+)$", options.get("xpath", ""))
        if "rowTag" not in options and not tag:
            raise SourceError("An XML source needs the option rowTag, or an xpath that ends in it.")
        return flatten(reader.option("rowTag", options.get("rowTag") or tag.group(1)).xml(source.path))
    return reader.format(kind).load(source.path)


def _read_csv(spark: SparkSession, source: Source, options: dict) -> DataFrame:
    """CSV with a header. Cells listed in ``na_values`` are missing. Without a
    schema, a column whose other cells are all true/false, whole or decimal
    numbers gets that type; finding out takes one pass. Whole numbers beyond
    bigint become decimals, and text beyond 38 digits, never doubles.

    Quotes inside quoted cells are doubled, and a quoted cell may hold line
    breaks; give multiLine=false for files without any, to read parts of a file
    side by side. Rows with more or fewer cells than the header, and files of a
    folder whose headers differ, are errors.
    """
    reader = spark.read.options(
        quote=options.pop("quote", '"'),
        escape=options.pop("escape", '"'),
        multiLine=options.pop("multiLine", "true"),
        mode=options.pop("mode", "FAILFAST"),
        enforceSchema=options.pop("enforceSchema", "false"),
        header=options.pop("header", "true"),
        sep=options.pop("delimiter", options.pop("sep", ",")),
        encoding=options.pop("encoding", "utf-8"),
    ).options(**options)
    raw = reader.option("inferSchema", "false").csv(source.path)
    missing = list(source.na_values)
    cells = raw.select(
        [F.when(~ref(c).isin(missing), ref(c)).alias(c) if missing else ref(c) for c in raw.columns]
    )
    if source.schema:
        wanted = spark.createDataFrame([], source.schema).schema
        return cells.select(
            [ref(n).cast(f.dataType).alias(f.name) for n, f in zip(raw.columns, wanted.fields, strict=True)]
        )
    patterns = {
        "boolean": r"^\s*([Tt]rue|TRUE|[Ff]alse|FALSE)\s*$",
        "bigint": r"^\s*[+-]?\d{1,18}\s*$",
        "decimal(38,0)": r"^\s*[+-]?\d{1,38}\s*$",
        "double": r"^\s*[+-]?(\d{1,15}|\d+\.\d*|\.\d+|(\d+\.?\d*|\.\d+)[eE][+-]?\d+)\s*$",
    }
    seen = cells.agg(
        *[F.count(ref(c)).alias(f"n{i}") for i, c in enumerate(raw.columns)],
        *[
            F.count_if(ref(c).rlike(p)).alias(f"{kind}{i}")
            for i, c in enumerate(raw.columns)
            for kind, p in patterns.items()
        ],
    ).first()
    out = []
    for i, c in enumerate(raw.columns):
        fits = [k for k in patterns if seen[f"n{i}"] and seen[f"{k}{i}"] == seen[f"n{i}"]]
        out.append(F.trim(ref(c)).cast(fits[0]).alias(c) if fits else ref(c))
    return cells.select(out)


def _read_jdbc(spark: SparkSession, kind: str, source: Source) -> DataFrame:
    """Give partitionColumn, lowerBound, upperBound and numPartitions as
    options to read in parallel; without them JDBC reads in one task."""
    options = dict(source.options)
    if kind in JDBC:
        url, driver = JDBC[kind]
        parts = {k: options.pop(k, "") for k in ("host", "port", "database")}
        options.setdefault("url", url.format(**parts))
        options.setdefault("driver", driver)
    if "url" not in options:
        raise SourceError("A JDBC source needs a url.")
    relation = f"({source.query}) countercheck_query" if source.query else _table(source)
    return spark.read.format("jdbc").options(**options).option("dbtable", relation).load()


def _read_mongodb(spark: SparkSession, source: Source) -> DataFrame:
    """Needs the MongoDB Spark connector on the class path."""
    reader = spark.read.format("mongodb").options(**source.options)
    if source.table:
        reader = reader.option("collection", source.table)
    if source.query:
        reader = reader.option("aggregation.pipeline", '[{"$match": ' + source.query + "}]")
    df = flatten(reader.load())
    return df.withColumn("_id", F.col("_id").cast("string")) if "_id" in df.columns else df
