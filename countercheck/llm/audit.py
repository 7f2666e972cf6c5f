"""Which filter removes what, in every order: exact Shapley values of filters.

Each document is reduced to the set of filters it fails. From the counts of
those sets, the removals of all coalitions of filters are tabulated (32 for five
filters). Everything else follows from that table: what a filter removes at a
step of an order is the difference of two coalitions, and the Shapley values
solve a least squares problem over all coalitions with the Shapley kernel as
weights, under the constraint that the values add up to the whole. Its normal
equations are solved in fractions, so the values are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countercheck.llm.support import stored

MOST = 7  # filters: 128 coalitions, 5040 orders
SALTS = 1 << 20  # over which rows without a key are spread

RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_filters(text: Column) -> dict[str, Column]:
    """Conditions under which a text fails: A short, B repetitive, C shouting, D with signs.

    A null text counts as empty.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return {
        "A": n < 50,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < n * 65,
        "C": capitals * 100 > F.length(text).cast("long") * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def failures(
    df: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, Column],
    key: str = "doc_id",
    text: str = "text",
    part: str = "source",
) -> DataFrame:
    """How many documents of a part fail the same filters: ``part, mask, good, toxic, n``.

    Bit i of ``mask`` stands for the i-th of ``filters``; the bit after the last
    means that a smaller key has the identical text, anywhere in the table.

    Every row counts, repeated ones too. Rows that share key and text don't
    repeat each other. A null key is neither smaller nor larger than another and
    has no labels. A null text equals an empty one, a null part the part ''. A
    key labelled several times is good, or toxic, if any of its labels says so.

    Only digests of texts are shuffled. Copies of one text are folded in the map
    task, and keys of a text are compared by their minimum, so neither a text
    that a third of the rows share nor a large part meets in one task.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))
    own = df.select(
        F.col(f"`{key}`").alias("key"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(body, 256)).alias("same"),
        mask.alias("mask"),
    )
    own = own.withColumn("salt", F.when(F.col("key").isNull(), F.pmod(F.xxhash64("same"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col("quality"), F.col("toxic")).filter("key is not null")
    known = known.groupBy("key").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = known.withColumn("salt", F.lit(0).cast("long"))
    no = F.lit(False)
    rows = own.join(known, ["key", "salt"], "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    kind = ["same", "part", "mask", "good", "toxic"]
    rows = rows.groupBy("key", "salt", *kind).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.when(F.col("key").isNotNull(), F.struct("key", "n"))).alias("first")
    unkeyed = F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("unkeyed")
    rows = stored(rows.groupBy(*kind).agg(F.sum("n").alias("n"), first, unkeyed), "audit-texts")
    least = rows.groupBy("same").agg(F.min("first.key").alias("least"))
    rows = rows.join(least, "same")
    alone = F.col("unkeyed") + F.when(F.col("first.key") == F.col("least"), F.col("first.n")).otherwise(0)
    bit = F.lit(1 << len(filters))
    both = F.array(
        F.struct(F.col("mask").alias("m"), alone.alias("n")),
        F.struct(F.col("mask").bitwiseOR(bit).alias("m"), (F.col("n") - alone).alias("n")),
    )
    cells = rows.select("part", "good", "toxic", F.explode(both).alias("x"))
    cells = cells.groupBy("part", F.col("x.m").alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n"))
    return cells.filter("n > 0")


def coalitions(cells: DataFrame, filters: int) -> DataFrame:
    """One row a part: ``total`` documents, and what each coalition of filters removes.

    ``removed``, ``good`` and ``toxic`` are arrays; place S counts the documents
    that fail any filter in the set of bits S.
    """

    def table(counted: Column, name: str) -> Column:
        hit = (F.col("mask").bitwiseAND(F.lit(s)) != 0 for s in range(1 << filters))
        return F.array(*(F.sum(F.when(h & counted, F.col("n")).otherwise(0)) for h in hit)).alias(name)

    return cells.groupBy("part").agg(
        F.sum("n").alias("total"),
        table(F.lit(True), "removed"),
        table(F.col("good"), "good"),
        table(F.col("toxic"), "toxic"),
    )


def solve(rows: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """The solution of a regular system of linear equations, by elimination."""
    n = len(rows)
    both = [[*row, r] for row, r in zip(rows, right, strict=True)]
    for i in range(n):
        k = next(k for k in range(i, n) if both[k][i])
        both[i], both[k] = both[k], both[i]
        both[i] = [x / both[i][i] for x in both[i]]
        for k in range(n):
            if k != i and both[k][i]:
                both[k] = [x - both[k][i] * y for x, y in zip(both[k], both[i], strict=True)]
    return [row[n] for row in both]


def shapley(value: list[int], filters: int) -> list[Fraction]:
    """Shapley values of a game given by the value of each coalition.

    They minimise the kernel-weighted squares of ``value[S] - sum of S's values``
    over all S but the empty and the whole, and add up to the whole's value. The
    normal equations get one more unknown, the multiplier of that constraint.
    """
    if filters == 1:
        return [Fraction(value[1] - value[0])]
    whole = (1 << filters) - 1
    normal = [[Fraction(0)] * (filters + 1) for _ in range(filters + 1)]
    right = [Fraction(0)] * (filters + 1)
    for s in range(1, whole):
        members = [i for i in range(filters) if s >> i & 1]
        k = len(members)
        weight = Fraction(filters - 1, comb(filters, k) * k * (filters - k))
        for i in members:
            right[i] += weight * (value[s] - value[0])
            for j in members:
                normal[i][j] += weight
    for i in range(filters):
        normal[i][filters] = normal[filters][i] = Fraction(1)
    right[filters] = Fraction(value[whole] - value[0])
    return solve(normal, right)[:filters]


def steps(total: int, removed: list[int], good: list[int], toxic: list[int], names: str) -> Iterator[tuple]:
    """Counts of every step of every order: order, step and the numbers of ``RESULT``."""
    n = len(names)
    whole = (1 << n) - 1
    shares = [factorial(n) * x for x in shapley(removed, n)]
    if any(x.denominator != 1 for x in shares):
        raise ArithmeticError(f"{shares} are not whole")
    for order in permutations(range(n)):
        text, before = "".join(names[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            gone = removed[after] - removed[before]
            yield (
                text,
                step,
                total - removed[after],
                gone,
                removed[1 << i] - gone,
                removed[whole] - removed[whole ^ 1 << i],
                good[after] - good[before],
                toxic[after] - toxic[before],
                int(shares[i]),
            )
            before = after


def interactions(cells: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step; see ``RESULT``.

    ``names`` has a letter for each bit of the mask. ``kept`` documents are left
    after the step, ``removed`` go in it, ``redundant`` ones fail its filter but
    went earlier, ``unique_fails`` fail no other filter; ``good_lost`` and
    ``toxic_lost`` are those removed here with that label. ``shapley`` is what
    the filter removes summed over all orders. A part is one row here, so a task
    holds a few hundred numbers of it. No documents: no rows.
    """
    if not 1 <= len(names) <= MOST:
        raise ValueError(f"1 to {MOST} filters, not {len(names)}")
    columns = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = steps(row["total"], row["removed"], row["good"], row["toxic"], names)
                values = zip(*((row["part"], *x) for x in found), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=columns)

    return coalitions(cells, len(names)).mapInArrow(run, RESULT)


def audit(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", repeated: str = "E"
) -> DataFrame:
    """The filters of ``text_filters`` and the one for repeated texts, audited together."""
    filters = text_filters(F.col(f"`{text}`"))
    return interactions(failures(df, labels, filters, key, text, part), "".join(filters) + repeated)
