"""Mixing sources to target weights by fitting token budgets exactly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countercheck.functions.names import free_name
from countercheck.llm.support import put, stored

SEED = 42
LANES = 256  # hash ranges that documents of one source and length are counted in
DYNAMIC = 1 << 16  # words of a budget that dynamic programming settles
MOST = 3  # times a document is taken at most
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Add ``target`` to one row per source (``key``, ``total``, in the order of ``place``).

    The sum of all totals is shared by weight; none gets more than MOST times
    its total, and what is above is shared again among the others. Sources are
    sorted by the share at which they are full; the level at which the rest
    stands follows from running sums. The windows see one row per source.
    """
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]),
        ((F.row_number().over(W.orderBy("place")) - 1) % len(weights) + 1).cast("int"),
    )
    full = F.col("total") * MOST
    each = put(sizes, {"weight": weight.cast("long")})
    each = put(each, {"full_at": full / F.col("weight")})
    everything = W.partitionBy()
    before = W.orderBy("full_at", "place").rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("total").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    each = put(each, {"level": rest / left})
    stands = F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "place", "level"))
    level = F.min(stands).over(everything)["level"]
    target = F.when(F.col("full_at") <= level, full.cast("double")).otherwise(level * F.col("weight"))
    return put(each, {"target": F.coalesce(target, full.cast("double"))}).drop("weight", "full_at", "level")


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take, so that their sum comes near the budget.

    First the same share of every size, rounded down; then, from the largest
    size down, more of them while the rest exceeds DYNAMIC words; the last part
    by a bounded knapsack over all sums up to the rest, which by then is at most
    DYNAMIC words or less than any larger size that is left. The sum never
    exceeds the budget. ``sizes`` are distinct and over 0.
    """
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = np.array([int(n) * budget // total for n in counts.tolist()], np.int64)
    rest = budget - int((sizes * taken).sum())
    for i in np.argsort(-sizes, kind="stable").tolist():
        if rest <= DYNAMIC:
            break
        spare = 0 if sizes[i] > DYNAMIC // 2 else DYNAMIC // 2
        more = min(int(counts[i] - taken[i]), max(0, (rest - spare) // int(sizes[i])))
        taken[i] += more
        rest -= more * int(sizes[i])
    if rest <= 0:
        return taken
    # by[s]: the item that first reached the sum s. An item is so many documents
    # of one size: 1, 2, 4, ... and what is left of its count.
    by = np.full(rest + 1, -1, np.int64)
    by[0] = 0
    items: list[tuple[int, int]] = [(0, 0)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, left, part = int(sizes[i]), min(int(counts[i] - taken[i]), rest // int(sizes[i])), 1
        while left > 0 and by[rest] < 0:
            n = min(part, left)
            left, part = left - n, part * 2
            new = np.flatnonzero((by[: rest + 1 - n * size] >= 0) & (by[n * size :] < 0)) + n * size
            by[new] = len(items)
            items.append((i, n))
        if by[rest] >= 0:
            break
    at = int(np.flatnonzero(by >= 0).max())
    while at:
        i, n = items[by[at]]
        taken[i] += n
        at -= n * int(sizes[i])
    return taken


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    """For one source: by size, the copies of every document and how many get one more."""
    rows = rows.sort_values("size")
    sizes, counts = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    total = int((sizes * counts).sum())
    budget = min(round(float(rows["target"].iloc[0])), MOST * total)
    copies, rest = divmod(budget, total) if total else (0, 0)
    used = sizes > 0
    more = np.zeros(len(sizes), np.int64)
    if rest:
        more[used] = fit(sizes[used], counts[used], rest)
    return pd.DataFrame({"key": rows["key"], "size": sizes, "copies": copies, "more": more})


def mix(
    df: DataFrame,
    record: list[str],
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = (5, 2, 1),
    seed: int = SEED,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """How often to take each document so that sources meet their target weights.

    Returns the columns of ``record`` and ``carry`` with ``size`` (words of the text),
    ``source_size``, ``target`` and ``taken`` (words taken, repeats counted).
    Names that meet one of these give way to it. Sources in the order of their code points, null last, weigh ``weights`` in turn.

    Documents are counted by source and exact size; from these counts a task
    per source fits the budget (see ``fit``). It sees a row per distinct size,
    not per document. Which documents of a size are taken is decided by a
    seeded hash of record, source and text, whatever ``carry`` holds; the same
    table gives the same mix.
    Documents of one size are counted in LANES hash ranges, and only the place
    in its own range is ever ranked, so a hot source or size spreads.

    A null or blank text has size 0 and is taken with 0 words. A null source is
    a source. Rows repeated in full stay rows; as many of them are taken as of
    any others. An empty table gives no rows.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`")), F.lit(""))
    columns = [F.col(f"`{c}`") for c in dict.fromkeys([*record, source, text])]
    digest = put(
        df.select(
            *[F.col(f"`{c}`") for c in [*record, *carry]],
            key.alias("mix key"),
            F.xxhash64(F.lit(seed), *columns).alias("mix hash"),
            words(F.col(f"`{text}`")).alias("mix size"),
        ),
        {"size": F.col("mix size"), "lane": F.pmod(F.col("mix hash"), F.lit(LANES)).cast("int")},
    ).drop("mix size")
    digest = stored(digest, "mix")
    lanes = digest.groupBy(F.col("mix key").alias("key"), "size", "lane").agg(F.count(F.lit(1)).alias("n"))
    lanes = stored(lanes, "mix-lanes")
    counts = lanes.groupBy("key", "size").agg(F.sum("n").alias("n"))
    sources = counts.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("total"))
    place = F.struct((F.col("key") == "").cast("int").alias("last"), "key")
    goals = stored(targets(put(sources, {"place": place}), weights).drop("place"), "mix-targets")
    plan = (
        counts.join(goals, "key")
        .groupBy("key")
        .applyInPandas(_plan, "key string, size long, copies long, more long")
    )
    earlier = W.partitionBy("key", "size").orderBy("lane").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    picks = lanes.join(plan, ["key", "size"]).withColumn("before", before)
    picks = picks.join(goals, "key").select(
        F.col("key").alias("mix key"),
        "size",
        "lane",
        "copies",
        F.greatest(F.lit(0), F.col("more") - F.col("before")).alias("mix more"),
        F.col("total").alias("source_size"),
        "target",
    )
    picks = stored(picks, "mix-picks")
    spot = F.row_number().over(
        W.partitionBy("mix key", "size", "lane").orderBy("mix hash", *[F.col(f"`{c}`") for c in record])
    )
    out = digest.join(picks, ["mix key", "size", "lane"])
    out = put(out, {"mix spot": spot})
    taken = F.col("size") * (F.col("copies") + (F.col("mix spot") <= F.col("mix more")).cast("long"))
    names = ["size", "source_size", "target"]
    kept = [c for c in [*record, *carry] if c.lower() not in {*names, "taken"}]
    return out.select(*[F.col(f"`{c}`") for c in kept], *names, taken.alias("taken"))


def take(df: DataFrame, record: list[str], **options) -> DataFrame:
    """The rows that the mix takes, with the columns of the table, each as often as it takes it.

    Documents without words, which are no part of any budget, are left out. Rows
    that are equal in full are taken together as often as their parts say. Texts
    are read twice and moved once.
    """
    own = [F.col(f"`{c}`") for c in df.columns]
    row, n, more, each = (free_name(df.columns, f"mix {x}") for x in ("row", "copies", "more", "copy"))
    whole = F.xxhash64(*own)
    picks = mix(put(df, {row: whole}), record, carry=(row,), **options)
    copies = F.sum(F.when(F.col("size") > 0, F.col("taken") / F.col("size"))).cast("int").alias(n)
    picks = picks.groupBy(row).agg(copies, (F.count(F.lit(1)) > 1).alias(more)).filter(F.col(n) > 0)
    out = put(df, {row: whole}).join(stored(picks, "mix-taken").hint("merge"), row).drop(row)
    once = out.filter(F.col(more)).dropDuplicates([c for c, kind in df.dtypes if "map<" not in kind])
    out = out.filter(~F.col(more)).unionByName(once)
    return out.select(*own, F.explode(F.array_repeat(F.lit(0), F.col(n))).alias(each)).select(*own)
