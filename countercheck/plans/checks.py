"""Running checks: read the sides, compute, store detail, record the run."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countercheck.operators import aggregates, completeness, counts, duplicates, files
from countercheck.operators import integrity, profile, row_diff, schema_diff
from countercheck.sinks import storage
from countercheck.sinks.run_table import RunTable, new_run_id, now
from countercheck.sources.catalog import foreign_keys_of, session_table_catalog
from countercheck.sources.load import Source, format_of, load


class CheckError(ValueError):
    """A check is not described well enough to run."""


@dataclass(frozen=True)
class Check:
    """One check: its module, the sides it reads and the module's settings.

    A side is a ``Source``, or the settings of one, or a DataFrame; for a file
    comparison, a path.
    """

    module: str
    source: object
    target: object = None
    settings: Mapping[str, object] = field(default_factory=dict)
    name: str | None = None


@dataclass(frozen=True)
class Outcome:
    name: str
    module: str
    status: str
    run_id: str | None
    summary: Mapping[str, object]
    error: str | None = None


#: A module turns its sides and settings into named sections of detail, and a
#: function that makes the one-row summary, with a ``status``, from them. The
#: sections are stored first, so a summary reads results instead of sides
#: wherever it can.
Sections = dict[str, DataFrame]
Result = tuple[Sections, Callable[[Sections], DataFrame]]


def _schema(source: DataFrame, target: DataFrame) -> Result:
    """Both sides are catalogs, see ``_catalog``."""
    title = "Column Comparison"
    diff = schema_diff.schema_diff(source, target)
    return {title: diff}, lambda stored: schema_diff.schema_summary(stored[title])


def _catalog(spark: SparkSession, side: object) -> DataFrame:
    """Catalog rows of one side, under the name ``table``. A session table's
    declared lengths and defaults take part; other sides have only types."""
    if isinstance(side, Mapping):
        side = Source(**side)
    df, declared = read_side(spark, side), None
    if isinstance(side, Source) and side.table and not side.query and format_of(side) == "table":
        declared = session_table_catalog(spark, side.table)
    if declared is None:
        return schema_diff.catalog_of(spark, {"table": df})
    read = F.array(*[F.lit(c.lower()) for c in df.columns])
    place = F.array_position(read, F.lower("column_name")).cast("int") - 1
    named = declared.withColumns({"table_name": F.lit("table"), "position": place})
    return named.filter(F.col("position") >= 0)


def _record_count(source, target, group_by=(), **tolerance) -> Result:
    if not group_by:
        return {}, lambda stored: counts.record_count(source, target, **tolerance)
    title = "Group Breakdown"
    by_group = counts.record_count_by_group(source, target, group_by)
    return {title: by_group}, lambda stored: counts.count_verdict(stored[title], **tolerance)


def _duplicate(source, target, keys: Sequence[str] = (), sample_limit=None) -> Result:
    rows = duplicates.duplicate_rows(source, keys, sample_limit)
    return {"Duplicate Rows": rows}, lambda stored: duplicates.duplicate_summary(source, keys)


def _nullability(source, target, threshold_percent=100.0, **settings) -> Result:
    stats, title = completeness.null_stats(source, **settings), "Column Statistics"
    return {title: stats}, lambda stored: completeness.null_score(stored[title], threshold_percent)


def _aggregation(source, target, metrics=(), **settings) -> Result:
    wanted = [m if isinstance(m, aggregates.Metric) else aggregates.Metric(**m) for m in metrics]
    comparison = aggregates.aggregate_compare(source, target, wanted, **settings)
    title = "Aggregation Comparison"
    return {title: comparison}, lambda stored: aggregates.aggregate_summary(stored[title])


def _declared_keys(foreign_keys: object, tables: Mapping[str, object], **tolerance) -> Result:
    """All keys that a catalog declares between the given tables."""
    spark = SparkSession.active()
    sides = {name: read_side(spark, side) for name, side in tables.items()}
    declared = foreign_keys_of(read_side(spark, foreign_keys))
    known = [fk for fk in declared if fk.table in sides and fk.referred_table in sides]
    if not known:
        raise CheckError("No foreign key is declared between the given tables")
    title = "Foreign Keys"
    sweep = integrity.foreign_key_sweep(sides, known, **tolerance)
    return {title: sweep}, lambda stored: integrity.sweep_summary(stored[title])


def _integrity(
    source, target, child_keys=(), parent_keys=(), sample_limit=None, foreign_keys=None, tables=None, **tolerance
) -> Result:
    """Keys named here, between source and target; or, with ``foreign_keys``, the
    rows of a catalog (see ``foreign_keys_of``), those it declares between ``tables``."""
    if foreign_keys is not None:
        return _declared_keys(foreign_keys, tables or {}, **tolerance)
    rows = integrity.orphans(source, target, child_keys, parent_keys, sample_limit)
    return {"Orphan Rows": rows}, lambda stored: integrity.orphan_summary(
        source, target, child_keys, parent_keys, **tolerance
    )


def _profiling(source, target, columns=(), top_n=5) -> Result:
    sections = {
        "Column Profiles": profile.profile(source, columns),
        "Top Values": profile.top_values(source, columns, top_n),
    }
    return sections, lambda stored: source.agg(F.count("*").alias("total_rows")).select(
        "total_rows",
        F.lit(len(columns or source.columns)).alias("columns_profiled"),
        F.lit("PASS").alias("status"),
    )


def _full_data(source, target, keys: Sequence[str] = (), **settings) -> Result:
    """The classified rows are stored, and summary and sections read back from
    there, so nothing is compared twice. ``run_check`` owns that table: it is
    removed when the sections are written, or when keys turn out to repeat."""
    options = row_diff.RowDiffOptions(**settings)
    strict = options.on_duplicate_key == "error"
    if strict:
        options = replace(options, on_duplicate_key="count")
    diff = row_diff.row_diff(source, target, keys, options)
    diff = replace(diff, rows=storage.stored(diff.rows, "row-diff", "diff_status"), only_in=None)
    if strict:
        repeated = diff.duplicate_rows().first()
        for side in ("source", "target"):
            if repeated[side]:
                raise row_diff.DuplicateKeyError(side, repeated[side])
    sections = {
        "Mismatches": diff.mismatches(),
        "Missing in Target": diff.missing(),
        "Extra in Target": diff.extra(),
        "Matched": diff.matched(),
    }
    return sections, lambda stored: diff.summary()


def _file_comparison(source: DataFrame, target: DataFrame, algorithm="sha256") -> Result:
    sides = [files.checksums(listed, algorithm) for listed in (source, target)]
    title = "Files"
    return {title: files.compare_files(*sides)}, lambda stored: files.file_summary(stored[title])


MODULES: dict[str, Callable[..., Result]] = {
    "Schema Validation": _schema,
    "Record Count Validation": _record_count,
    "Duplicate Validation": _duplicate,
    "Nullability Validation": _nullability,
    "Aggregation Validation": _aggregation,
    "Full Data Validation": _full_data,
    "Referential Integrity": _integrity,
    "Data Profiling": _profiling,
    "File Comparison": _file_comparison,
}


def read_side(spark: SparkSession, side: object, module: str = "") -> DataFrame | None:
    if side is None or isinstance(side, DataFrame):
        return side
    if isinstance(side, str) and module == "File Comparison":
        return files.list_files(spark, side)
    if isinstance(side, Source):
        return load(spark, side)
    if isinstance(side, Mapping):
        return load(spark, Source(**side))
    raise CheckError(f"Cannot read {side!r}")


def _result(spark: SparkSession, check: Check) -> Result:
    if check.module == "Schema Validation":
        sides = [_catalog(spark, side) for side in (check.source, check.target)]
    else:
        sides = [read_side(spark, side, check.module) for side in (check.source, check.target)]
    return MODULES[check.module](*sides, **check.settings)


def run_check(
    table: RunTable,
    check: Check,
    project_id: str = "default",
    suite_id: str | None = None,
    measured: Callable[[], Result] | None = None,
) -> Outcome:
    """Run one check, store its detail and record it. A failure is recorded as
    an ERROR run and raised again. ``measured`` makes the result from what a
    scan shared with other checks has found, so the sides are not read."""
    spark, started = table.spark, now()
    run_id, name = new_run_id(started), check.name or check.module
    try:
        if check.module not in MODULES:
            raise CheckError(f"Unknown module: '{check.module}'")
        with storage.owned(spark):
            sections, summarise = measured() if measured else _result(spark, check)
            table.details.save(run_id, sections)
            values = summarise(table.details.load_all(run_id)).first().asDict()
        status = values.pop("status")
        if check.module == "Full Data Validation":
            values["execution_start"] = started.isoformat()
            values["execution_end"] = now().isoformat()
        error = None
    except Exception as problem:
        status, values, error = "ERROR", {}, problem
    table.record(
        check.module,
        name,
        status,
        started,
        values,
        source=_label(check.source),
        target=_label(check.target),
        error=None if error is None else str(error),
        project_id=project_id,
        suite_id=suite_id,
        run_id=run_id,
    )
    if error is not None:
        raise error
    return Outcome(name, check.module, status, run_id, values)


def _label(side: object) -> str | None:
    """Where a side comes from, for the record; no options, which may hold
    credentials."""
    if isinstance(side, Mapping):
        side = Source(**side)
    if isinstance(side, Source):
        return side.path or side.table or side.query
    return side if isinstance(side, str) else None
