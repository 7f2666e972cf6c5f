"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by pseudo-random rotations (sign flips and Hadamard
transforms) and falls to the nearest of the signed axes. Each table has two
rotations of its own, and a vector's bucket there is its pair of axes. A query
looks into the pairs of axes that lie nearest to it, in every table; candidates
are ranked by exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countercheck.llm.support import stored

TABLES = 10
RECALL = 0.95  # that probes are chosen for
ROTATIONS = 3
SEED = 42
BLOCK = 4096  # vectors of a cell that are compared in one task
PAIRS = 65_536  # pairs of vectors that a task compares at a time


def _rotated(unit: np.ndarray, table: int, seed: int) -> np.ndarray:
    width = 1 << max(0, (unit.shape[1] - 1).bit_length())
    out = np.zeros((len(unit), width))
    out[:, : unit.shape[1]] = unit
    rng = np.random.default_rng([seed, table])
    for _ in range(ROTATIONS):
        out *= rng.choice([-1.0, 1.0], width)
        step = 1
        while step < width:  # the fast Hadamard transform, by pairs of blocks
            pair = out.reshape(len(out), -1, 2, step)
            low, high = pair[:, :, 0].copy(), pair[:, :, 1]
            pair[:, :, 0] += high
            pair[:, :, 1] = low - high
            step *= 2
        out /= np.sqrt(width)
    return np.concatenate([out, -out], axis=1)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length from a list column without nulls, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def most_frequent_length(df: DataFrame, vector: str) -> int:
    """Of the vectors; ties to the longest, 1 where there are none."""
    lengths = df.groupBy(F.size(f"`{vector}`").alias("n")).count().filter("n > 0")
    row = lengths.orderBy(F.desc("count"), F.desc("n")).first()
    return row["n"] if row else 1


def usable(vector: Column, dimensions: int | None = None) -> Column:
    """Whether a vector has a direction and, if given, so many components.

    False for null, empty and zero vectors and such with null or non-finite components.
    """
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = ~odd & F.exists(vector, lambda x: x != 0)
    if dimensions is not None:
        good &= F.size(vector) == dimensions
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def tame(rows: np.ndarray) -> np.ndarray:
    """Rows divided by powers of two, so that squares neither overflow nor vanish."""
    _, power = np.frexp(np.abs(rows).max(axis=-1, keepdims=True))
    return np.ldexp(rows, -power)


def cosine(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Cosines of a vector with rows, or of rows with rows; equal rows give equal values."""
    one, many = tame(one), tame(many)
    norms = np.sqrt((many * many).sum(axis=-1)) * np.sqrt((one * one).sum(axis=-1))
    return (many * one).sum(axis=-1) / norms


def probes_for(vectors: int, width: int, k: int, tables: int, recall: float = RECALL) -> int:
    """Pairs of axes that a query has to look into in each table.

    Chosen for vectors without any structure, the hardest case: the k-th nearest
    of n then has about the cosine c that a normal deviate exceeds k times in n,
    and the query's components along the axes of such a neighbour are normal
    around c times that neighbour's own. The more vectors, the nearer they lie
    and the smaller a part of all pairs is enough. Clustered vectors need less.
    """
    normal, axes = NormalDist(), 2 * (1 << max(0, (width - 1).bit_length()))
    near = max(0.0, normal.inv_cdf(1 - min(0.5, k / max(vectors, 1))) / width**0.5)
    near = min(near, 0.99)
    highest = normal.inv_cdf(1 - 0.56 / axes)  # mean of a unit vector's largest component, scaled
    each = 1 - (1 - recall) ** (1 / tables)
    least = near * highest * 2**0.5 - (1 - near * near) ** 0.5 * normal.inv_cdf(each)
    return min(axes**2, max(2, int(np.ceil(axes**2 * (1 - normal.cdf(least))))))


def _axes(vectors: np.ndarray, table: int, seed: int) -> list[np.ndarray]:
    """Components along all signed axes, by each of the table's two rotations."""
    unit = tame(vectors)
    unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    return [_rotated(unit, 2 * table + level, seed) for level in (0, 1)]


def _cell(bucket: np.ndarray, axes: int, vectors: int) -> np.ndarray:
    """Buckets dealt in their order into cells of about half a BLOCK of vectors."""
    cells = max(1, min(axes**2, -(-2 * vectors // BLOCK)))
    return bucket.astype(np.int64) * cells // axes**2


def _by_shape(batch: pa.RecordBatch, rows: int) -> Iterator[tuple[pa.Table, np.ndarray, int]]:
    """Slices with vectors of one length, and how many vectors of it there are."""
    table = pa.Table.from_batches([batch])
    sizes = table["dims"].to_numpy()
    for width in np.unique(sizes):
        own = table.take(pa.array(np.flatnonzero(sizes == width)))
        for k in range(0, len(own), rows):
            part = own.slice(k, rows).combine_chunks()
            yield part, matrix(part["embedding"]), part["total"][0].as_py()


def _indexed(tables: int, seed: int):
    """Add ``cells`` and ``buckets``, the ones of a vector in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, vectors, total in _by_shape(batch, 2048):
                cells, buckets = [], []
                for t in range(tables):
                    one, two = _axes(vectors, t, seed)
                    buckets.append(one.argmax(axis=1) * one.shape[1] + two.argmax(axis=1))
                    cells.append(_cell(buckets[-1], one.shape[1], total))
                starts = pa.array(np.arange(0, len(part) * tables + 1, tables), pa.int32())
                for name, values in (("cells", cells), ("buckets", buckets)):
                    flat = pa.array(np.stack(values, axis=1).ravel(), pa.int32())
                    part = part.append_column(name, pa.ListArray.from_arrays(starts, flat))
                yield from part.to_batches()

    return run


def _best_pairs(one: np.ndarray, two: np.ndarray, count: int) -> np.ndarray:
    """Numbers of the pairs of axes with the largest sums, ``count`` for each row.

    In the order of each rotation, a pair of ranks (i, j) has at least (i + 1)(j + 1)
    sums no smaller than its own, so only pairs of ranks up to that product can be among them.
    """
    width = one.shape[1]
    i = np.arange(width).repeat(width)
    j = np.tile(np.arange(width), width)
    able = (i + 1) * (j + 1) <= count
    first, second = np.argsort(-one, axis=1, kind="stable"), np.argsort(-two, axis=1, kind="stable")
    one, two = np.take_along_axis(one, first, 1), np.take_along_axis(two, second, 1)
    i, j = i[able], j[able]
    best = np.argpartition(-(one[:, i] + two[:, j]), min(count, len(i)) - 1, axis=1)[:, :count]
    return np.take_along_axis(first, i[best], 1) * width + np.take_along_axis(second, j[best], 1)


def _asked(probes: int | None, k: int, tables: int, seed: int):
    """A row for each cell that a query looks into, with the buckets it wants there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, vectors, total in _by_shape(batch, 256):
                for t in range(tables):
                    one, two = _axes(vectors, t, seed)
                    width = one.shape[1]
                    count = min(width**2, probes or probes_for(total, vectors.shape[1], k, tables))
                    wanted = np.sort(_best_pairs(one, two, count), axis=1)  # so by cell as well
                    cell = _cell(wanted, width, total)
                    new = np.ones(cell.shape, bool)
                    new[:, 1:] = cell[:, 1:] != cell[:, :-1]
                    at = np.flatnonzero(new.ravel())
                    starts = pa.array(np.append(at, new.size), pa.int32())
                    out = part.take(pa.array(at // new.shape[1]))
                    out = out.append_column("tab", pa.array(np.full(len(at), t), pa.int32()))
                    out = out.append_column("cell", pa.array(cell.ravel()[at], pa.int32()))
                    lists = pa.ListArray.from_arrays(starts, pa.array(wanted.ravel(), pa.int32()))
                    yield from out.append_column("buckets", lists).to_batches()

    return run


_SCORES = "query_id long, vec_id long, score double"


def _pairs(queries: pd.DataFrame, ids: np.ndarray, buckets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of queries and of vectors in their buckets, PAIRS or one query at a time."""
    sizes = queries["buckets"].map(len).to_numpy()
    asker = np.arange(len(queries)).repeat(sizes)
    wanted = np.concatenate(queries["buckets"].tolist())
    low, high = np.searchsorted(buckets, wanted, "left"), np.searchsorted(buckets, wanted, "right")
    some = high > low
    asker, low, many = asker[some], low[some], (high - low)[some]
    ends = np.cumsum(many)
    start = 0
    while start < len(asker):
        done = ends[start - 1] if start else 0
        stop = np.searchsorted(ends, done + PAIRS, "right")
        stop = np.searchsorted(asker, asker[min(stop, len(asker) - 1)], "left") if stop < len(asker) else stop
        if stop <= start:
            stop = np.searchsorted(asker, asker[start], "right")
        own = many[start:stop]
        offset = np.arange(own.sum()) - (np.cumsum(own) - own).repeat(own)
        one, two = asker[start:stop].repeat(own), low[start:stop].repeat(own) + offset
        other = queries["vec_id"].to_numpy(np.int64)[one] != ids[two]
        yield one[other], two[other]
        start = stop


def _compare(k: int):
    """The k best of a block of vectors for each query, among the buckets it wants."""

    def run(_, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(queries) and len(vectors):
            vectors = vectors.sort_values(["bucket", "vec_id"], kind="stable")
            ids, buckets = vectors["vec_id"].to_numpy(np.int64), vectors["bucket"].to_numpy()
            rows = np.array(vectors["embedding"].tolist(), np.float64)
            asked = np.array(queries["embedding"].tolist(), np.float64)
            keys = queries["vec_id"].to_numpy(np.int64)
            for one, two in _pairs(queries, ids, buckets):
                score = cosine(asked[one], rows[two])
                order = np.lexsort((ids[two], -score, one))
                one, two, score = one[order], two[order], score[order]
                first = np.searchsorted(one, one, "left")  # of the same query
                best = np.arange(len(one)) - first < k
                parts.append((keys[one[best]], ids[two[best]], score[best]))
        columns = zip(*parts, strict=True) if parts else ([np.zeros(0)],) * 3
        named = zip(("query_id", "vec_id", "score"), ("int64", "int64", "float64"), columns, strict=True)
        return pd.DataFrame({name: np.concatenate(list(c)).astype(kind) for name, kind, c in named})

    return run


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    tables: int = TABLES,
    probes: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's k nearest.

    Every vector is in the index. Nearest is the largest cosine, in double
    precision on the vectors as they are; ties go to the smaller ``vec_id``. A
    query's own key is no candidate of its own. Fewer than k candidates give
    fewer rows. A query with fewer than k candidates in its buckets gets the
    best of those. ``probes`` is the number of buckets a query looks into in each
    table, by default what ``probes_for`` says; all of them (four times the
    square of the dimensions, rounded up to a power of two) make the search exact.

    Both frames have ``key`` (whole number) and ``vector``; other columns are
    not read. Rows with a null key and vectors that ``usable`` rejects take no
    part; vectors of different lengths never meet. Rows with the same key and
    vector count once; an empty index or no queries give no rows.

    The index is stored once, with the buckets of all tables as numbers. A cell
    is a range of buckets, down to a single one where there are many vectors; a
    cell of more than BLOCK vectors is split into blocks that its queries visit, so no task holds more than a block and its queries, and only k
    rows per query and block leave it.
    """
    element = vectors.schema[vector].dataType.elementType
    kind = "float" if isinstance(element, T.FloatType) else "double"

    def own(df: DataFrame) -> DataFrame:
        rows = df.select(
            F.col(f"`{key}`").cast("long").alias("vec_id"),
            F.col(f"`{vector}`").cast(f"array<{kind}>").alias("embedding"),
        )
        rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct()
        return rows.withColumn("dims", F.size("embedding"))

    good = own(vectors)
    lengths = good.groupBy("dims").agg(F.count(F.lit(1)).alias("total"))  # a row per length
    lengths = stored(lengths, "ann-lengths")
    shape = f"vec_id long, embedding array<{kind}>, dims int, total long"

    def sized(df: DataFrame) -> DataFrame:
        return df.join(lengths, "dims").select("vec_id", "embedding", "dims", "total")

    index = sized(good).mapInArrow(_indexed(tables, seed), f"{shape}, cells array<int>, buckets array<int>")
    index = stored(index.drop("total"), "ann-index")
    place = ["dims", "tab", "cell"]
    cells = index.select("dims", F.posexplode("cells").alias("tab", "cell"))
    blocks = F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int")
    sizes = stored(cells.groupBy(place).agg(blocks.alias("blocks")).filter("blocks > 1"), "ann-sizes")
    pairs = F.posexplode(F.arrays_zip("cells", "buckets")).alias("tab", "at")
    each = index.select("vec_id", "embedding", "dims", pairs)
    each = each.select("vec_id", "embedding", "dims", "tab", "at.cells", "at.buckets").toDF(
        "vec_id", "embedding", *place, "bucket"
    )
    block = F.pmod(F.xxhash64("vec_id"), F.coalesce("blocks", F.lit(1))).cast("int")
    each = each.join(sizes, place, "left").withColumn("block", block).drop("blocks")
    asked = sized(own(queries)).mapInArrow(
        _asked(probes, k, tables, seed), f"{shape}, tab int, cell int, buckets array<int>"
    )
    visits = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    asked = asked.drop("total").join(sizes, place, "left").withColumn("block", visits).drop("blocks")
    place.append("block")
    found = asked.groupBy(place).cogroup(each.groupBy(place)).applyInPandas(_compare(k), _SCORES)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
