"""One scan of a side for all checks of a batch that read it.

Record counts, completeness and ungrouped aggregates each need one row of
figures from a side. Checks first say which figures they want; then every side
is aggregated once for all of them, the row is stored, and each check makes
its result from stored rows alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countercheck.functions.names import ref
from countercheck.operators import aggregates, completeness, counts
from countercheck.plans.checks import Check, CheckError, Result, read_side
from countercheck.sinks import storage
from countercheck.sources.load import Source

Answer = Callable[[], Result]
ROWS = "rows"


class Scan:
    """A side, the figures asked of it, and, once run, the row that holds them."""

    def __init__(self, side: DataFrame) -> None:
        self.side = side
        self.metrics: list[aggregates.Metric] = []
        self.conditions: dict[str, Column] = {ROWS: F.lit(True)}
        self._row: DataFrame | None = None

    def count(self, conditions: Mapping[str, Column]) -> dict[str, str]:
        """Ask for counts; what each will be called in the row."""
        first = len(self.conditions)
        names = {label: f"count {first + i}" for i, label in enumerate(conditions)}
        self.conditions.update({names[label]: c for label, c in conditions.items()})
        return names

    def measure(self, metrics: Sequence[aggregates.Metric]) -> list[str]:
        """Ask for aggregates; those asked before are not computed again."""
        aggregates.measured(self.side, [], metrics)  # raises if a column is missing or not a number
        places = []
        for metric in metrics:
            plain = aggregates.Metric(metric.column.lower(), metric.function)
            if plain not in self.metrics:
                self.metrics.append(plain)
            places.append(f"m{self.metrics.index(plain)}")
        return places

    def run(self) -> None:
        found = aggregates.measured(self.side, [], self.metrics, self.conditions)
        self._row = storage.stored(found, "shared-scan")

    def row(self, names: Mapping[str, str]) -> DataFrame:
        """The row, with figures under the asker's own names."""
        if self._row is None:
            raise CheckError("The scan of this side has failed.")
        return self._row.select(*[ref(have).alias(want) for want, have in names.items()])


def _counts(source: Scan, target: Scan, **tolerance) -> Answer:
    def answer() -> Result:
        zero = F.lit(0).cast("bigint")
        s = source.row({"n": ROWS}).select(F.col("n").alias("source_count"), zero.alias("target_count"))
        t = target.row({"n": ROWS}).select(zero.alias("source_count"), F.col("n").alias("target_count"))
        return {}, lambda stored: counts.count_verdict(s.unionByName(t), **tolerance)

    return answer


def _completeness(source: Scan, target: object, threshold_percent=100.0, **settings) -> Answer:
    columns, conditions = completeness.null_conditions(source.side, **settings)
    names = source.count(conditions)

    def answer() -> Result:
        stats = completeness.stats_of(source.row({"total_rows": ROWS, **names}), columns)
        title = "Column Statistics"
        return {title: stats}, lambda stored: completeness.null_score(stored[title], threshold_percent)

    return answer


def _aggregates(source: Scan, target: Scan, metrics=(), tolerance_percent=0.0) -> Answer:
    wanted = aggregates.checked([m if isinstance(m, aggregates.Metric) else aggregates.Metric(**m) for m in metrics])
    places = [scan.measure(wanted) for scan in (source, target)]

    def answer() -> Result:
        rows = [
            scan.row({f"m{i}": p for i, p in enumerate(place)})
            for scan, place in zip((source, target), places, strict=True)
        ]
        comparison = aggregates.compare_measured(*rows, wanted, (), tolerance_percent)
        title = "Aggregation Comparison"
        return {title: comparison}, lambda stored: aggregates.aggregate_summary(stored[title])

    return answer


ASK: dict[str, tuple[int, Callable[..., Answer]]] = {  # sides read, and how to ask them
    "Record Count Validation": (2, _counts),
    "Nullability Validation": (1, _completeness),
    "Aggregation Validation": (2, _aggregates),
}


def _key(side: object) -> object:
    """Equal for sides that read the same."""
    return repr(Source(**side) if isinstance(side, Mapping) else side)


def shared(spark: SparkSession, checks: Mapping[str, Check]) -> dict[str, Answer]:
    """Run one scan per side that several of the checks read, and return, for
    each check that can do with it, how to make its result from there.

    Checks that need more than one row of figures, or that share no side, are
    not in the result and run on their own; so does a check that asks for
    something a side cannot give, and every check on a side whose scan fails:
    one broken check stops no other. Rows belong to the open scope.
    """
    sides: dict[str, list[object]] = {}
    for name, check in checks.items():
        if check.module in ASK and not check.settings.get("group_by"):
            read = [check.source, check.target][: ASK[check.module][0]]
            if None not in read:
                sides[name] = read
    def keys(name: str) -> list[object]:
        return [_key(side) for side in sides[name]]

    readers = Counter(key for name in sides for key in keys(name))
    scans: dict[object, Scan] = {}
    asked: dict[str, Answer] = {}
    for name in sides:
        if all(readers[key] == 1 for key in keys(name)):
            continue
        try:
            for key, side in zip(keys(name), sides[name], strict=True):
                if key not in scans:
                    scans[key] = Scan(read_side(spark, side))
            settings = {k: v for k, v in checks[name].settings.items() if k != "group_by"}
            own = [scans[key] for key in keys(name)]
            asked[name] = ASK[checks[name].module][1](*own, *[None] * (2 - len(own)), **settings)
        except Exception:  # its own run meets the same problem, and records it
            continue
    failed = set()
    for key in {key for name in asked for key in keys(name)}:
        try:
            scans[key].run()
        except Exception:
            failed.add(key)
    return {name: answer for name, answer in asked.items() if not failed.intersection(keys(name))}
