"""Near-duplicate vectors by a forest of random-projection trees with spill.

A tree splits the vectors by their projection on a random direction, again and
again. Vectors near a split go to both sides, so that close vectors seldom part,
and trees with other directions find the pairs that one tree parts. Vectors are
compared within leaves and equal labels; pairs that pass the exact cosine are
links, and links are united to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countercheck.llm.components import components
from countercheck.llm.neighbours import cosine, matrix, most_frequent_length, usable
from countercheck.llm.support import stored

THRESHOLD = 0.98
TREES = 4
LEAF = 2048  # vectors that a leaf should hold
BLOCK = 2048  # vectors of a leaf and label that are compared in one task
SAMPLE = 32_768  # vectors that the splits are fitted on
LEAST = 64  # of these that a leaf needs
SEED = 42
ROUTE = 8192  # vectors of an open leaf that one task routes at a time


@dataclass(frozen=True)
class Tree:
    """Nodes by number, the root first. ``low`` and ``high`` are nodes, or -1 - leaf."""

    directions: np.ndarray
    splits: np.ndarray
    low: np.ndarray
    high: np.ndarray
    spill: float

    def leaves(self, unit: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows in it); a row near splits is in several leaves."""
        if not len(self.splits):
            return [(0, np.arange(len(unit)))]
        out, todo = [], [(0, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            at = unit[rows] @ self.directions[node]
            for child, own in (
                (self.low[node], rows[at <= self.splits[node] + self.spill]),
                (self.high[node], rows[at > self.splits[node] - self.spill]),
            ):
                if len(own):
                    (out if child < 0 else todo).append((-1 - child if child < 0 else child, own))
        return out


def fit_tree(sample: np.ndarray, scale: float, spill: float, leaf: int, tree: int, seed: int) -> tuple[Tree, int]:
    """A tree and its number of leaves. One row of the sample stands for ``scale`` vectors."""
    rng = np.random.default_rng([seed, tree])
    directions, splits, low, high, leaves = [], [], [], [], 0
    todo = [(np.arange(len(sample)), -1, False)]
    while todo:
        rows, parent, upper = todo.pop()
        split = None
        if len(rows) * scale > leaf and len(rows) >= 2 * LEAST:
            direction = rng.standard_normal(sample.shape[1])
            direction /= np.sqrt(direction @ direction)
            at = sample[rows] @ direction
            split = float(np.quantile(at, rng.uniform(0.4, 0.6)))
            parts = rows[at <= split + spill], rows[at > split - spill]
            if max(map(len, parts)) > 0.9 * len(rows):
                split = None  # too dense to split: blocks deal with it
        if split is None:
            child, leaves = -1 - leaves, leaves + 1
        else:
            child = len(splits)
            directions.append(direction)
            splits.append(split)
            low.append(0)
            high.append(0)
            todo += [(parts[0], child, False), (parts[1], child, True)]
        if parent >= 0:
            (high if upper else low)[parent] = child
    shape = (len(splits), sample.shape[1])
    nodes = np.array(directions).reshape(shape), np.array(splits), np.array(low), np.array(high)
    return Tree(*nodes, spill), leaves


def _routed(forest: list[tuple[Tree, int]]):
    """Add ``leaves``, the numbers of all leaves a vector is in, ascending over all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(matrix(batch["embedding"]))
            own: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for tree, first in forest:
                for leaf, rows in sorted(tree.leaves(unit), key=lambda x: x[0]):
                    for row in rows.tolist():
                        own[row].append(first + leaf)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own, pa.list_(pa.int64()))], names=[*batch.schema.names, "leaves"]
            )

    return run


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _fitted(leaf: int, spill: float, seed: int):
    """A tree below one leaf, from a sample of its vectors."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["leaf"].iloc[0])
        unit = _unit(np.array(rows["embedding"].tolist(), np.float64))
        scale = rows["size"].iloc[0] / len(rows)
        tree, _ = fit_tree(unit, scale, spill, leaf, number % 2**63, seed)
        nodes = tree.directions.ravel(), tree.splits, tree.low, tree.high
        return pd.DataFrame([(number, *map(list, nodes))], columns=["leaf", "directions", "splits", "low", "high"])

    return run


def _split(spill: float):
    """Vectors of a block of a leaf with their leaves below; ``whole`` where it isn't split."""

    def run(_, rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out = rows[["class", "embedding", "leaf"]]
        if not len(trees) or not len(trees["splits"].iloc[0]) or not len(rows):
            return out.assign(child=0, whole=True)
        unit = _unit(np.array(rows["embedding"].tolist(), np.float64))
        known = trees.iloc[0]
        shape = (len(known["splits"]), unit.shape[1])
        tree = Tree(np.reshape(known["directions"], shape), known["splits"], known["low"], known["high"], spill)
        parts = [out.iloc[own].assign(child=child, whole=False) for child, own in tree.leaves(unit)]
        return pd.concat(parts)

    return run


def refined(routed: DataFrame, leaf: int, sample: int, spill: float, seed: int) -> DataFrame:
    """Split leaves of more than twice ``leaf`` vectors again, until none is left.

    The first trees come from one sample of the whole table, so their leaves grow
    with it. Each open leaf gets a tree of its own, fitted by a task on about
    ``sample`` of its vectors, and its vectors go on in blocks. A round
    divides leaves by hundreds. A leaf that can't be split, as its vectors lie
    too close, stays as it is. Numbers of new leaves are hashes; should two
    meet, their vectors are compared in one leaf and nothing is lost.
    """
    wide = F.count(F.lit(1)).alias("size")
    places = routed.select("class", F.explode("leaves").alias("leaf"))
    still = stored(places.groupBy("leaf").agg(wide).filter(F.col("size") > 2 * leaf), "forest-open")
    if still.isEmpty():
        return routed
    done = places.join(still, "leaf", "left_anti").select("class", "leaf")
    todo = routed.select("class", "embedding", F.explode("leaves").alias("leaf")).join(still, "leaf")
    kind = "class long, embedding array<double>, leaf long, child int, whole boolean"
    nodes = "leaf long, directions array<double>, splits array<double>, low array<int>, high array<int>"
    blocks = F.ceil(F.col("size") / F.lit(ROUTE)).cast("int")
    while not still.isEmpty():
        todo = stored(todo.select("class", "embedding", "leaf", "size"), "forest-todo")
        every = F.ceil(F.col("size") / F.lit(sample))
        some = todo.filter(F.pmod(F.xxhash64("class", "leaf"), every) == 0)
        trees = stored(some.groupBy("leaf").applyInPandas(_fitted(leaf, spill, seed), nodes), "forest-trees")
        trees = trees.join(still, "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = todo.withColumn("block", F.pmod(F.xxhash64("class"), blocks).cast("int"))
        below = dealt.groupBy("leaf", "block").cogroup(trees.groupBy("leaf", "block"))
        moved = below.applyInPandas(_split(spill), kind)
        moved = stored(moved.withColumn("leaf", F.xxhash64("leaf", "child")).drop("child"), "forest-moved")
        sizes = moved.groupBy("leaf").agg(wide, F.max("whole").alias("whole"))
        still = sizes.filter((F.col("size") > 2 * leaf) & ~F.col("whole")).drop("whole")
        still = stored(still, "forest-open")
        done = done.unionByName(moved.join(still, "leaf", "left_anti").select("class", "leaf"))
        todo = moved.join(still, "leaf")
    leaves = done.groupBy("class").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    return stored(routed.drop("leaves").join(leaves, "class").select(*routed.columns), "forest-refined")


def _linked(rows: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have at least this cosine, by the exact value where it is close."""
    unit = _unit(rows)
    near = unit @ unit.T
    out = near >= threshold
    for i, j in zip(*np.nonzero(np.abs(near - threshold) < 1e-9), strict=True):
        if i < j:
            out[i, j] = out[j, i] = cosine(rows[i], rows[j : j + 1])[0] >= threshold
    np.fill_diagonal(out, False)
    return out


def _compare(threshold: float):
    """Of one block: links per vector that no earlier leaf has counted, and a spanning forest."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        out = {"a": [], "b": [], "links": []}
        rows = np.array(block["embedding"].tolist(), np.float64)
        linked = _linked(rows, threshold)
        chunk = block["chunk"].to_numpy()
        one, two = block["one"].iloc[0], block["two"].iloc[0]
        if one != two:
            linked &= chunk[:, None] != chunk[None, :]
        some = np.flatnonzero(linked.any(axis=1))
        if len(some):
            linked, block = linked[np.ix_(some, some)], block.iloc[some]
            ids, weight = block["class"].to_numpy(np.int64), block["n"].to_numpy(np.int64)
            leaf = block["leaf"].iloc[0]
            earlier = sorted({x for own in block["leaves"] for x in own if x < leaf})
            column = {x: i for i, x in enumerate(earlier)}
            member = np.zeros((len(block), len(earlier)), np.float32)
            for i, own in enumerate(block["leaves"]):
                member[i, [column[x] for x in own if x < leaf]] = 1
            first = linked & ~(member @ member.T > 0)
            counts = first @ weight
            at = np.flatnonzero(counts)
            out["a"] += ids[at].tolist()
            out["b"] += ids[at].tolist()
            out["links"] += counts[at].tolist()
            seen = np.zeros(len(ids), bool)
            for root in np.argsort(ids, kind="stable"):
                if seen[root]:
                    continue
                reached = np.zeros(len(ids), bool)
                reached[root] = True
                front = reached
                while front.any():
                    front = linked[front].any(axis=0) & ~reached
                    reached = reached | front
                seen |= reached
                rest = ids[reached & (ids != ids[root])]
                out["a"] += rest.tolist()
                out["b"] += [ids[root]] * len(rest)
                out["links"] += [0] * len(rest)
        return pd.DataFrame(out).astype("int64")

    return run


def near_duplicates(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    trees: int = TREES,
    sample: int = SAMPLE,
    leaf: int = LEAF,
    seed: int = SEED,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row.

    Two vectors of equal label are linked if their cosine, in double precision,
    is at least ``threshold``. ``n_links`` counts the other vectors linked
    directly, ``component_id`` is the smallest key that links lead to, itself
    included, and ``kept`` says whether that is the row's own. Links are only
    ever exact; a pair is missed if all trees part it, which the spill makes
    unlikely: a tree parts a pair at a split only if it lies further from the
    split than half the typical gap of a pair at the threshold on both sides.

    Rows with a null label or key, vectors that ``usable`` rejects and vectors of
    another length than most have link with nothing. Equal vectors of a label
    are one class, compared once and counted as many; a row repeated in full is
    a vector of its own each time, linked with the others. Splits are fitted on ``sample`` vectors of the
    table, which come to the driver, and those below leaves that are still too
    large on as many of each leaf (``refined``); every vector is routed. A leaf and label
    with more than BLOCK classes is compared as pairs of chunks. The key's
    column keeps its name, other columns are not returned. An empty table gives
    no rows.
    """
    width = most_frequent_length(df, vector)
    rows = df.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{label}`").cast("string").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("embedding"),
    )
    able = F.col("key").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"), width)
    good = rows.filter(able)
    classes = good.groupBy("label", "embedding").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "forest-classes")
    total = classes.count()
    taken = classes.select("embedding").orderBy(F.xxhash64("embedding")).limit(sample).toPandas()
    unit = _unit(np.array(taken["embedding"].tolist(), np.float64)) if total else np.zeros((0, width))
    spill = float(np.sqrt(2 * (1 - threshold) / width))
    forest, first = [], 0
    for number in range(trees):
        tree, leaves = fit_tree(unit, total / max(1, len(unit)), spill, leaf, number, seed)
        forest.append((tree, first))
        first += leaves
    kind = "label string, embedding array<double>, least long, n long, class long, leaves array<long>"
    routed = stored(classes.mapInArrow(_routed(forest), kind).drop("least"), "forest-routed")
    routed = refined(routed, leaf, sample, spill, seed)
    places = routed.select("label", "class", F.explode("leaves").alias("leaf"))
    sizes = places.groupBy("leaf", "label").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("chunks"))
    sizes = stored(sizes.filter("chunks > 1"), "forest-sizes")
    each = routed.withColumn("leaf", F.explode("leaves")).join(sizes, ["leaf", "label"], "left")
    each = each.withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    each = each.withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    each = each.withColumn("one", F.least("chunk", "other")).withColumn("two", F.greatest("chunk", "other"))
    blocks = each.drop("chunks", "other").groupBy("leaf", "label", "one", "two")
    found = stored(blocks.applyInPandas(_compare(threshold), "a long, b long, links long"), "forest-found")
    links = found.filter("a = b").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    united = components(found.filter("a <> b").select("a", "b")).withColumnRenamed("node", "class")
    known = classes.join(links, "class", "left").join(united, "class", "left")
    known = known.select(
        "label",
        "embedding",
        "least",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("root", "class").alias("root"),
    )
    known = stored(known, "forest-known")
    roots = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = stored(known.join(roots, "root").drop("root", "least"), "forest-components")
    linked = good.join(known, ["label", "embedding"]).select("key", "n_links", "component_id")
    alone = rows.filter(~able).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("key").alias(key),
        "n_links",
        "component_id",
        F.col("key").eqNullSafe(F.col("component_id")).alias("kept"),
    )
