"""Phrases whose words occur together more often than apart.

Positions of a text are suffix pointers: each stands for the words from there
on, up to the longest phrase, the end of its piece, or a pair of words that is
too rare. Leading words route them: single words and then pairs are counted
over all texts, pairs that are too rare end a suffix, and every task gets all
suffixes that begin with the same pair. There the pointers are sorted by
multikey three-way quicksort: a pivot word splits them into smaller, equal and
larger ones, the equal ones go on with the next word, and the size of an equal
part is the number of places of its phrase. Parts that are too small are
abandoned. Pairs are counted by a hash of 64 bits; if two share one, both may be
let through, to be abandoned here.

Before they are sent, equal suffixes of a million words are folded to one
with a weight, so a line in a third of all texts arrives once from each task. A
pair with more than 1/ROUTES of all places is routed by three words, and by four
if its second pair is as heavy; sizes of phrases shorter than that are added up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countercheck.llm.support import small_batches, stored

LEAST = 30  # places of a phrase
LONGEST = 4  # words; the packing of suffixes in _suffixes is made for this
TOP = 2000
COVERED = 80  # percent of a phrase's places from which a longer one makes it superfluous
UNKNOWN = "und"
CHUNK = 1 << 20  # words that are folded together
PIECE = 1 << 20  # bytes whose words are split at a time
BLOCK = 1 << 20  # suffixes that are sorted together, or all of a route if they are more
BITS = 25  # of the filters of frequent words and pairs, as a power of two
ROUTES = 1024
SALTS = 64
SEED = 42
EMIT = 1 << 16  # rows of an Arrow batch

#: A-Z turn to a-z, a tab to a blank, and all that ends a piece to a full stop.
ENDS = b".,;:!?\n\x0b\x0c\r"
LETTERS = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 46 if b in ENDS else b for b in range(256))


class _Ids(dict):
    """Numbers of a language's words in a chunk."""

    def __init__(self, lang: str, words: list[tuple[str, bytes]]):
        super().__init__({b".": 0})
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        self.words.append((self.lang, word))
        found = self[word] = len(self.words) - 1
        return found


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[tuple[str, bytes]], np.ndarray]]:
    """Words and the texts as numbers of words, 0 between pieces; ``size`` numbers or more at a time.

    Batches have the columns lang and text. A text isn't split between chunks.
    """
    words: list[tuple[str, bytes]] = [("", b".")]
    langs: dict[str, _Ids] = {}
    parts, n = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = (text.as_py() or "").encode().translate(LETTERS).replace(b".", b" . ")
            ids = langs.get(lang) or langs.setdefault(lang, _Ids(lang, words))
            start = 0
            while start < len(data):
                stop = data.find(b" ", start + PIECE)
                stop = len(data) if stop < 0 else stop
                tokens = data[start:stop].split()
                parts.append(np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens)))
                n += len(tokens)
                start = stop
            parts.append(np.zeros(1, np.int32))
            n += 1
            if n >= size:
                yield words, np.concatenate(parts)
                words = [("", b".")]
                langs, parts, n = {}, [], 0
    if n:
        yield words, np.concatenate(parts)


Rows = Callable[[slice], list[pa.Array]]


def _rows(names: list[str], size: int, rows: Rows) -> Iterator[pa.RecordBatch]:
    """``size`` rows in batches, whose columns ``rows`` makes."""
    for k in range(0, size, EMIT):
        yield pa.RecordBatch.from_arrays(rows(slice(k, min(size, k + EMIT))), names=names)


def _texts(words: list[tuple[str, bytes]]) -> tuple[pa.Array, pa.Array]:
    """Language and text of each word number."""
    langs, texts = zip(*words, strict=True)
    return pa.array(langs, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of chunks with their places; those of all words of a language under a null word."""
    names = ["lang", "phrase", "n"]
    for words, ids in chunks(batches, CHUNK):
        counts = np.bincount(ids, minlength=len(words))
        counts[0] = 0
        langs, texts = _texts(words)
        total = pa.table({"lang": langs, "n": counts}).group_by("lang").aggregate([("n", "sum")])
        none = pa.nulls(len(total), pa.string())
        yield pa.RecordBatch.from_arrays([total["lang"].combine_chunks(), none, total["n_sum"].combine_chunks()], names=names)
        langs, texts, n = langs[1:], texts[1:], pa.array(counts[1:], pa.int64())
        yield from _rows(names, len(n), lambda part: [langs[part], texts[part], n[part]])  # noqa: B023


class Filter:
    """A set of hashes of which only bits are kept: it may hold more, never less. Its size is fixed."""

    def __init__(self, hashes: DataFrame):
        """``hashes`` has one long column."""
        bit = F.pmod(F.col(hashes.columns[0]), F.lit(1 << BITS)) + 1  # Spark counts positions from 1
        rows = (
            hashes.select(bit.alias("bit"))
            .groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        )
        data = np.zeros((1 << BITS) // 8, np.uint8)
        for bucket, bits in rows.toLocalIterator():
            data[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, np.uint8)[: len(data)]
        self.data = data

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.astype(np.uint64) & np.uint64((1 << BITS) - 1)
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def word_hash(lang: str, word: bytes) -> int:
    """As Spark's ``xxhash64(lang, word)``, unsigned."""
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang.encode(), SEED))


def _word_hashes(words: list[tuple[str, bytes]]) -> np.ndarray:
    return np.array([word_hash(*w) for w in words], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def _pairs_of(words: list[tuple[str, bytes]], ids: np.ndarray, hashes: np.ndarray, frequent: Filter):
    """Distinct pairs of frequent words in a row: numbers of both, a hash, places; and each position's pair or -1."""
    known = frequent.holds(hashes)
    known[0] = False
    at = np.flatnonzero(known[ids[:-1]] & known[ids[1:]])
    keys, which, counts = np.unique(ids[at].astype(np.int64) << 32 | ids[at + 1], return_inverse=True, return_counts=True)
    where = np.full(len(ids), -1, np.int64)
    where[at] = which
    first, second = keys >> 32, keys & 0xFFFFFFFF
    return first, second, mixed(mixed(hashes[first]) + hashes[second]), counts, where


def _pairs(frequent) -> Callable:
    """Hashes of pairs of frequent words in chunks, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, ids in chunks(batches, CHUNK):
            _, _, own, counts, _ = _pairs_of(words, ids, _word_hashes(words), frequent.value)
            columns = [pa.array(own.view(np.int64), pa.int64()), pa.array(counts, pa.int64())]
            yield from _rows(["pair", "n"], len(own), lambda part: [c[part] for c in columns])  # noqa: B023

    return run


_SUFFIXES = "lang string, phrase string, n long, whole int, route long"


def _suffixes(frequent, pairs, heavy) -> Callable:
    """Distinct suffixes of chunks with their weights: words up to LONGEST, while their pairs are frequent.

    ``route`` is a hash of the first ``whole`` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, ids in chunks(batches, CHUNK):
            hashes = _word_hashes(words)
            first, second, own, _, where = _pairs_of(words, ids, hashes, frequent.value)
            alive = np.append(pairs.value.holds(own), False)  # place -1 is no pair
            where[~alive[where]] = -1
            # A suffix is its first pair and a tail: nothing, one word more, or another pair behind.
            pair = np.concatenate([where, [-1, -1]])
            one, two, three = pair[:-2], pair[1:-1], pair[2:]
            tail = np.where(two < 0, 0, np.where(three < 0, 2 * np.append(ids, [0, 0])[2:].astype(np.int64) + 1, 2 * three + 2))
            at = np.flatnonzero(one >= 0)
            keys, counts = np.unique(one[at] << 32 | tail[at], return_counts=True)
            one, tail = keys >> 32, keys & 0xFFFFFFFF
            size = np.where(tail == 0, 2, np.where(tail & 1, 3, 4))
            third, fourth = tail >> 1, np.zeros(len(tail), np.int64)
            behind = third[size == 4] - 1
            third[size == 4], fourth[size == 4] = first[behind], second[behind]
            third[size == 2] = 0
            big = np.isin(own, heavy.value)
            middle = np.where(size > 2, second[one] << 32 | third, -1)
            heavy_keys = (first << 32 | second)[big]
            whole = np.where(big[one], np.where(np.isin(middle, heavy_keys), 4, 3), 2)
            route = own[one]
            route = np.where(whole > 2, mixed(route + hashes[third]), route)
            route = np.where(whole > 3, mixed(route + hashes[fourth]), route)
            langs, texts = _texts(words)

            def rows(part: slice) -> list[pa.Array]:
                lead, n = one[part], size[part]  # noqa: B023
                more = [pa.array(x[part], mask=n < k) for k, x in ((3, third), (4, fourth))]  # noqa: B023
                phrase = [texts.take(x) for x in (first[lead], second[lead], *more)]  # noqa: B023
                return [
                    langs.take(first[lead]),  # noqa: B023
                    pc.binary_join_element_wise(*phrase, " ", null_handling="skip"),
                    pa.array(counts[part], pa.int64()),  # noqa: B023
                    pa.array(whole[part], pa.int32()),  # noqa: B023
                    pa.array(route[part].view(np.int64), pa.int64()),  # noqa: B023
                ]

            yield from _rows(["lang", "phrase", "n", "whole", "route"], len(one), rows)

    return run


def quicksort(words: np.ndarray, weight: np.ndarray, whole: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Equal parts of suffixes as (one of their pointers, number of equal words, weight), by three-way partition.

    ``words`` has a column of numbers for each suffix, -1 after its last word. All
    suffixes with the same first ``whole`` words are here. Parts of less than
    ``least`` are abandoned, unless phrases shorter than ``whole`` may come from
    them, whose other places are elsewhere.
    """
    todo = [(np.arange(words.shape[1]), 0)]
    while todo:
        pointers, depth = todo.pop()
        while len(pointers):
            if max(2, depth + 1) >= whole and weight[pointers].sum() < least:
                break
            own = words[depth, pointers]
            pivot = sorted((own[0], own[len(own) // 2], own[-1]))[1]
            todo.append((pointers[own < pivot], depth))
            todo.append((pointers[own > pivot], depth))
            pointers = pointers[own == pivot]
            if pivot < 0:
                break  # their last word was the one before
            depth += 1
            size = int(weight[pointers].sum())
            if depth >= 2 and (size >= least or depth < whole):
                yield int(pointers[0]), depth, size
            if depth == len(words):
                break


def _sort(least: int) -> Callable:
    """Phrases and their sizes from suffixes that are ordered by whole and route."""

    def block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        langs, phrases = rows["lang"].chunk(0), rows["phrase"].chunk(0)
        weight, whole = rows["n"].to_numpy(), rows["whole"].to_numpy()
        split = pc.split_pattern(phrases, " ")
        numbers = split.flatten().dictionary_encode().indices.to_numpy()
        start = split.offsets.to_numpy().astype(np.int64)
        start, size = start[:-1] - start[0], np.diff(start)
        words = np.full((LONGEST, len(phrases)), -1, np.int32)
        for j in range(LONGEST):
            has = size > j
            words[j, has] = numbers[start[has] + j]
        spoken = langs.dictionary_encode().indices.to_numpy()
        found = []
        for lang in np.unique(spoken):
            for w in np.unique(whole[spoken == lang]):
                own = np.flatnonzero((spoken == lang) & (whole == w))
                for p, depth, n in quicksort(words[:, own], weight[own], int(w), least):
                    k = int(own[p])
                    found.append((langs[k].as_py(), " ".join(phrases[k].as_py().split(" ")[:depth]), n))
        if found:
            kinds = (pa.string(), pa.string(), pa.int64())
            columns = [pa.array(v, k) for v, k in zip(zip(*found, strict=True), kinds, strict=True)]
            yield from _rows(["lang", "phrase", "n"], len(found), lambda part: [c[part] for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < BLOCK:
                continue
            rows = pa.Table.from_batches(held)
            route = rows["route"].to_numpy()
            change = np.flatnonzero(route[1:] != route[:-1])
            if len(change):  # the last route may go on
                cut = int(change[-1]) + 1
                yield from block(rows.slice(0, cut))
                rest = rows.slice(cut).combine_chunks().to_batches()
                held, n = rest, sum(b.num_rows for b in rest)
        if held:
            yield from block(pa.Table.from_batches(held))

    return run


def _summed(counts: DataFrame, *by: str) -> DataFrame:
    """Sums of n. The chunks are folded already: folding once more before the shuffle would only take memory."""
    return counts.repartition(*by).groupBy(*by).agg(F.sum("n").alias("n"))


def phrases(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Places of all words and phrases of 2 to LONGEST words that have ``least`` or more, and number of words.

    Two tables: ``lang, phrase, n`` and ``lang, words``, per language, which is
    ``und`` where it is null. Pieces end at ``.,;:!?`` and line breaks, words
    at blanks and tabs, A-Z are lower-cased. Null texts have no words. Repeated
    rows count each time.
    """
    spark = df.sparkSession
    small_batches(spark)
    share = spark.sparkContext.broadcast
    own = df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text}`").alias("text"))
    words = _summed(own.mapInArrow(_words, "lang string, phrase string, n long"), "lang", "phrase")
    words = stored(words.filter(F.col("phrase").isNull() | (F.col("n") >= least)), "phrase-words")
    total = words.filter("phrase is null").select("lang", F.col("n").alias("words"))
    words = words.filter("phrase is not null")
    frequent = share(Filter(words.select(F.xxhash64("lang", "phrase"))))
    pairs = _summed(own.mapInArrow(_pairs(frequent), "pair long, n long"), "pair")
    pairs = stored(pairs.filter(F.col("n") >= least), "phrase-pairs")
    places = pairs.agg(F.sum("n")).first()[0] or 0
    heavy = pairs.filter(F.col("n").cast("decimal(38,0)") * ROUTES > places).select("pair").collect()  # below ROUTES rows
    heavy = share(np.array([r[0] for r in heavy], np.int64).view(np.uint64))
    suffixes = own.mapInArrow(_suffixes(frequent, share(Filter(pairs.select("pair"))), heavy), _SUFFIXES)
    routed = suffixes.repartition("route").sortWithinPartitions("route")
    longer = routed.mapInArrow(_sort(least), "lang string, phrase string, n long")
    longer = longer.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return stored(words.unionByName(longer), "phrase-counts"), total


def _first(phrase: Column, n: Column) -> Column:
    return F.call_function("substring_index", phrase, F.lit(" "), n)


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` collocations of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Candidates are phrases of 2 to 4 words with ``a >= least`` places. A cut into
    two parts with ``l`` and ``r`` places scores ``floor(2000000 a / (l + r))``;
    the cut with the lowest score counts, of equal ones the first. A candidate
    goes if a longer one that holds its words has COVERED percent of its places.
    ``n`` is the number of the language's words. The order is by score and ``a``
    from the highest, then by the phrase's bytes.

    Products are decimals of 38 digits. A language without candidates has no
    rows, and so has an empty table.
    """
    counts, total = phrases(df, text, lang, least)
    size = F.size(F.split("phrase", " ", -1))
    found = counts.withColumn("size", size).filter("size > 1")
    cuts = found.select("lang", "phrase", F.col("n").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": _first(F.col("phrase"), F.col("k")), "right": _first(F.col("phrase"), F.col("k") - F.col("size"))})
    part = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    scored = stored(cuts.join(part, ["lang", "left"]), "phrase-cuts")
    part = counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    scored = scored.join(part, ["lang", "right"])
    score = F.expr("cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0)) div cast(l + r as decimal(20,0))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r", "a")).alias("x")
    scored = scored.groupBy("lang", "phrase").agg(lowest).select("lang", "phrase", "x.*")

    # What a longer candidate holds: its runs of 2 words or more.
    runs = F.expr(
        "flatten(transform(sequence(2, size - 1), w -> transform(sequence(0, size - w),"
        " i -> array_join(slice(split(phrase, ' ', -1), i + 1, w), ' '))))"
    )
    inner = found.filter("size > 2").select("lang", F.explode(runs).alias("phrase"), "n")
    inner = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    wide = [F.col(c).cast("decimal(20,0)") for c in ("longer", "a")]
    kept = scored.join(inner, ["lang", "phrase"], "left")
    kept = kept.filter(F.col("longer").isNull() | (wide[0] * 100 < wide[1] * COVERED))

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    for by in (["lang", salt], ["lang"]):  # at most SALTS * top rows of a language meet
        kept = kept.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    return kept.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score"
    )
