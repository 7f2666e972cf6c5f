"""Results as files: numbered batches, CSV, JSON and exports of whole runs."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countercheck.functions.names import free_name, ref
from countercheck.operators.history import MODULE_CODES
from countercheck.sinks import storage
from countercheck.sinks.run_table import RunTable

# Fixed value: rows per batch.
BATCH_ROWS = 50_000
LISTED = 10_000  # batches that one task lists at a time

CSV_OPTIONS = {
    "header": "true",
    "lineSep": "\n",
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def with_code(module: str, name: str) -> str:
    """A suite's name behind its module's code; a code that is there already is not repeated."""
    code = MODULE_CODES[module] + "_"
    return re.sub(f"^(?:{code})?", code, name.strip(), count=1, flags=re.IGNORECASE)


def section_folder(path: str, position: int) -> str:
    """Where a section goes: by its position, so no two titles can meet."""
    return f"{path.rstrip('/')}/section-{position:04d}"


def number_rows(df: DataFrame, order_by: Sequence[str], index: str = "row_number") -> DataFrame:
    """Number the rows from 1 in the given order, over the whole table.

    A window without partitions would pull the table into one task. Instead
    the rows are sorted in parallel and stored with their partition and place,
    for whoever has a scope open to own; only one count per partition comes to
    the driver. List enough columns that rows of a frequent value can be told
    apart, as equal rows cannot be spread over tasks.
    """
    place = free_name(df.columns, "__place")
    ordered = df.orderBy(*[ref(c).asc_nulls_last() for c in order_by])
    ordered = storage.stored(ordered.withColumn(place, F.monotonically_increasing_id()), "numbered")
    # monotonically_increasing_id: partition number above bit 33, row below.
    part = F.shiftright(F.col(place), 33)
    sizes = ordered.groupBy(part.alias("part")).count().collect()
    offsets, total = [], 0
    for row in sorted(sizes, key=lambda r: r["part"]):
        offsets.append((row["part"], total))
        total += row["count"]
    if not offsets:
        return ordered.withColumn(index, F.lit(None).cast("bigint")).drop(place)
    starts = df.sparkSession.createDataFrame(offsets, "__part bigint, __start bigint")
    within = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ordered.join(F.broadcast(starts), part == F.col("__part"))
        .withColumn(index, F.col("__start") + within + 1)
        .drop(place, "__part", "__start")
    )


def batch_number(index: Column, batch_rows: int) -> Column:
    return F.floor((index - 1) / F.lit(batch_rows)) + 1


def batch_ranges(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """One row per batch: its name, number and range of rows, counted from 1.
    A table of at most ``batch_rows`` rows is one batch under its plain name;
    an empty one has the range 0 to 0. Only a count of the table is needed; the
    list is made in parts of LISTED batches, so a long one is spread over tasks."""
    if batch_rows < 1:
        raise ValueError("batch_rows must be at least 1.")
    total = F.greatest(F.ceil(F.col("rows") / F.lit(batch_rows)), F.lit(1)).cast("bigint")
    first = (F.col("number") - 1) * batch_rows + 1
    last = F.least(F.col("number") * batch_rows, F.col("rows"))
    parts = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total") - 1) / F.lit(LISTED)))
    from_, to = F.col("part") * LISTED + 1, F.least((F.col("part") + 1) * LISTED, F.col("total"))
    return (
        df.agg(F.count("*").alias("rows"))
        .withColumn("total", total)
        .withColumn("part", F.explode(parts))
        .repartition("part")
        .withColumn("number", F.explode(F.sequence(from_, to)))
        .select(
            F.when(F.col("total") == 1, F.lit(name))
            .otherwise(F.concat(F.lit(name + "_"), F.col("number").cast("string")))
            .alias("name"),
            "number",
            "total",
            F.when(F.col("rows") == 0, F.lit(0)).otherwise(first).cast("bigint").alias("first_row"),
            last.cast("bigint").alias("last_row"),
        )
        .orderBy("number")
    )


def _csv_columns(df: DataFrame) -> list[Column]:
    return [
        F.to_json(ref(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        else ref(f.name)
        for f in df.schema.fields
    ]


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, also when empty, and LF line ends. Values that CSV
    has no form for (lists, maps, records) are written as JSON."""
    df.select(_csv_columns(df)).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_batches(
    df: DataFrame,
    path: str,
    name: str,
    order_by: Sequence[str],
    batch_rows: int = BATCH_ROWS,
) -> list[str]:
    """Write every row once, in numbered batches under ``path``: folder
    ``batch=<n>`` per batch. Returns the batch names in order.

    Batches are written in parallel, each by one task; a batch has a bounded
    number of rows.
    """
    if batch_rows < 1:
        raise ValueError("batch_rows must be at least 1.")
    index = free_name(df.columns, "row_number")
    batch = free_name(df.columns, "batch")
    numbered = number_rows(df, order_by, index).withColumn(
        batch, batch_number(F.col(index), batch_rows)
    )
    (
        numbered.repartition(ref(batch))
        .sortWithinPartitions(batch, index)
        .select(*_csv_columns(df), ref(batch))
        .write.mode("overwrite")
        .partitionBy(batch)
        .options(**CSV_OPTIONS)
        .csv(path)
    )
    return [r["name"] for r in batch_ranges(numbered, name, batch_rows).collect()]


def summary_frame(spark: SparkSession, summary: Mapping[str, object]) -> DataFrame:
    rows = [(k, None if v is None else str(v)) for k, v in summary.items()]
    return spark.createDataFrame(rows, "metric string, value string")


def write_csv_report(
    spark: SparkSession, path: str, summary: Mapping[str, object], sections: Mapping[str, DataFrame]
) -> dict[str, str]:
    """One CSV folder per section, by position. With no section, or several,
    the summary has the folder ``summary``. ``sections`` lists position and
    title. Returns folder by title."""
    root = path.rstrip("/")
    if len(sections) != 1:
        write_csv(summary_frame(spark, summary), f"{root}/summary")
    written = {}
    for position, (title, df) in enumerate(sections.items()):
        written[title] = section_folder(root, position)
        write_csv(df, written[title])
    write_csv(section_list(spark, sections), f"{root}/sections")
    return written


def section_list(spark: SparkSession, titles) -> DataFrame:
    return spark.createDataFrame(list(enumerate(titles)), "position int, title string").coalesce(1)


def write_json_report(
    spark: SparkSession,
    path: str,
    title: str,
    summary: Mapping[str, object],
    sections: Mapping[str, DataFrame],
) -> dict[str, str]:
    """A folder of JSON records per section, by position, and ``report`` with
    title, time, summary and the sections' titles. Returns folder by title."""
    root = path.rstrip("/")
    head = (title, datetime.now(UTC).isoformat(), json.dumps(dict(summary), default=str), list(sections))
    spark.createDataFrame(
        [head], "title string, generated_at string, summary string, sections array<string>"
    ).coalesce(1).write.mode("overwrite").json(f"{root}/report")
    written = {}
    for position, (name, df) in enumerate(sections.items()):
        written[name] = section_folder(root, position)
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(written[name])
    return written


def export_manifest(runs: DataFrame) -> DataFrame:
    """One row per run with the folder its export goes to: the module's code
    and the whole run id, so no two runs share one, whatever they are called."""
    code = F.lit("run")
    for module, short in MODULE_CODES.items():
        code = F.when(F.col("module") == module, short).otherwise(code)
    return runs.select(
        F.concat_ws("-", code, "run_id").alias("folder"),
        "run_id",
        "module",
        "name",
        "status",
        "started_at",
        "runtime_seconds",
        F.coalesce("error", F.lit("")).alias("error_message"),
    )


def export_runs(
    table: RunTable, run_ids: Sequence[str], path: str, batch_rows: int = BATCH_ROWS
) -> DataFrame:
    """Write the summary and all detail of the given runs under ``path`` and
    return the manifest, which is written as well. Unknown ids are skipped.

    One folder per run, one folder per section in it, by position, in batches.
    """
    spark, root = table.spark, path.rstrip("/")
    asked = spark.createDataFrame([(r,) for r in dict.fromkeys(run_ids)], "run_id string")
    runs = table.runs().join(asked, "run_id", "left_semi")
    manifest = export_manifest(runs)
    summaries = runs.select("run_id", "summary")
    for row in manifest.join(summaries, "run_id").toLocalIterator():
        folder = f"{root}/{row['folder']}"
        write_csv(summary_frame(spark, json.loads(row["summary"])), f"{folder}/summary")
        sections = table.details.load_all(row["run_id"])
        write_csv(section_list(spark, sections), f"{folder}/sections")
        for position, (title, df) in enumerate(sections.items()):
            order = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
            write_batches(df, section_folder(folder, position), title, order, batch_rows)
    write_csv(manifest, f"{root}/manifest")
    return manifest
