"""Column-name matching that ignores case.

Spark's own ``spark.sql.caseSensitive`` is not used for this: a frame holding
both ``ID`` and ``id`` would be ambiguous there, while here the first one wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ColumnError(ValueError):
    """A named column does not exist, or cannot be used as asked."""


def by_folded_name(columns: Iterable[str]) -> dict[str, str]:
    """Case-folded name -> actual spelling; the left-most spelling wins."""
    spelling: dict[str, str] = {}
    for name in columns:
        spelling.setdefault(name.casefold(), name)
    return spelling


def find_columns(names: Sequence[str], columns: Iterable[str]) -> tuple[list[str], list[str]]:
    """Split ``names`` into (actual spellings found, names as typed not found)."""
    spelling = by_folded_name(columns)
    found = [spelling[n.casefold()] for n in names if n.casefold() in spelling]
    absent = [n for n in names if n.casefold() not in spelling]
    return found, absent


def require_columns(names: Sequence[str], columns: Iterable[str], what: str) -> list[str]:
    """Actual spellings of ``names``, or a ColumnError that lists the absent ones."""
    found, absent = find_columns(names, columns)
    if absent:
        raise ColumnError(f"{what} not found: {absent}")
    return found


def adopt_spelling(target: DataFrame, source: DataFrame) -> DataFrame:
    """Rename target columns that differ from a source column only by case."""
    spelling = by_folded_name(source.columns)
    taken = set(target.columns)
    renames = {}
    for name in target.columns:
        wanted = spelling.get(name.casefold(), name)
        if wanted not in taken:
            renames[name] = wanted
            taken.add(wanted)
    if not renames:
        return target
    return target.select([ref(n).alias(renames.get(n, n)) for n in target.columns])


def ref(name: str) -> Column:
    """Reference a column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(taken: Iterable[str], base: str) -> str:
    """``base``, with underscores added until it clashes with no column."""
    folded = {t.casefold() for t in taken}
    while base.casefold() in folded:
        base += "_"
    return base
