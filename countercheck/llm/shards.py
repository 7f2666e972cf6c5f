"""Sharding by fixed virtual slots and a versioned map from slot to shard."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countercheck.llm.support import put, stored
from countercheck.sinks.storage import exists, new_folder

SLOTS = 4096
TOLERANCE = 0.001  # of the mean shard; a smaller gap between shards is left alone


def slot_of(*parts: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record. It depends on the record and nothing else."""
    return F.pmod(F.xxhash64(*parts), F.lit(slots)).cast("long")


def rebalance(loads: np.ndarray, owner: np.ndarray, shards: int, tolerance: float = TOLERANCE) -> np.ndarray:
    """Edit a map so that the shards' loads get near equal, moving few slots.

    Each step takes the fullest and the emptiest shard and moves the slot that
    comes nearest to half their gap, or exchanges two slots if that comes nearer.
    Every step lessens the sum of squares, so it ends. Slots without load stay;
    ties go to the lowest shard and slot. ``loads`` and ``owner`` are by slot.
    """
    owner = owner.copy()
    held = np.bincount(owner, weights=loads, minlength=shards)[:shards].astype(np.int64)
    while (gap := held.max() - held.min()) > max(tolerance * held.mean(), 1):
        high, low = int(held.argmax()), int(held.argmin())
        rich, poor = np.flatnonzero(owner == high), np.flatnonzero(owner == low)
        moves = [(abs(2 * int(loads[s]) - gap), s, -1) for s in rich if 0 < loads[s] < gap]
        best = min(moves, default=None)
        if (best is None or best[0] > gap // 4) and len(poor):
            order = poor[np.argsort(loads[poor], kind="stable")]
            for s in rich:
                at = np.searchsorted(loads[order], loads[s] - gap / 2)
                for other in order[max(0, at - 1) : at + 1]:
                    less = int(loads[s] - loads[other])
                    if 0 < less < gap:
                        best = min(best or (gap, -1, -1), (abs(2 * less - gap), s, other))
        if best is None:
            break
        _, slot, other = best
        owner[slot] = low
        moved = int(loads[slot])
        if other >= 0:
            owner[other] = high
            moved -= int(loads[other])
        held[high] -= moved
        held[low] += moved
    return owner


def grow(loads: np.ndarray, owner: np.ndarray, shards: int) -> np.ndarray:
    """A map for more shards: slots move into the new shards only, none between old ones."""
    owner = owner.copy()
    old = int(owner.max()) + 1
    held = np.bincount(owner, weights=loads, minlength=shards).astype(np.int64)
    mean = int(loads.sum()) // shards
    for new in range(old, shards):
        while held[new] < mean:
            high = int(held[:old].argmax())
            fits = [s for s in np.flatnonzero(owner == high) if 0 < loads[s] <= mean - held[new]]
            if not fits:
                break
            slot = max(fits, key=lambda s: (min(loads[s], held[high] - mean), -s))
            owner[slot] = new
            held[high] -= loads[slot]
            held[new] += loads[slot]
    return owner


@dataclass(frozen=True)
class SlotMap:
    """Versions of a map, each a folder of Parquet that is written once."""

    spark: SparkSession
    path: str

    def _folder(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def save(self, version: int, owner: np.ndarray) -> None:
        rows = [(i, int(s)) for i, s in enumerate(owner)]
        df = self.spark.createDataFrame(rows, "slot long, shard int")
        df.coalesce(1).write.parquet(self._folder(version))  # an error if it is there already

    def latest(self) -> tuple[int, np.ndarray] | None:
        """The last version, one row a slot: bounded by the number of slots."""
        version = 0
        while exists(self.spark, f"{self._folder(version)}/_SUCCESS"):
            version += 1
        if not version:
            return None
        rows = self.spark.read.parquet(self._folder(version - 1)).collect()
        owner = np.zeros(len(rows), np.int64)
        for row in rows:
            owner[row["slot"]] = row["shard"]
        return version - 1, owner


def assign(
    df: DataFrame,
    record: list[str],
    text: str = "text",
    shards: int = 24,
    slots: int = SLOTS,
    path: str | None = None,
) -> DataFrame:
    """Put records into shards of near equal bytes.

    Returns the columns of ``record``, ``size`` (UTF-8 bytes of the text plus
    8), ``text_crc32``, ``virtual_slot``, ``shard``, ``map_version`` and
    ``slot``, the place of the row in its shard, without gaps from 0. Names of
    ``record`` that meet one of these give way to it.

    A record's virtual slot is a hash of ``record`` and the text's checksum and
    size. The bytes of each slot are summed, and the map is edited until shards
    are even: the last version under ``path`` if there is one, else slots dealt
    in turn; the edited map is stored as the next version. More shards than the
    last version has take slots only from the old ones before that.

    Null texts count as empty, null keys are a value like any other, rows that
    are repeated in full stay and share a slot. An empty table has no rows out
    and leaves the map as it was dealt. Only slots with their bytes and rows
    come to the driver: at most ``slots`` rows. A single record larger than a
    shard's share stays whole.
    """
    spark = df.sparkSession
    body = F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "utf-8")
    digest = put(
        df.select(*[F.col(f"`{c}`") for c in record], body.alias("text body")),
        {
            "size": F.octet_length(F.col("text body")).cast("long") + 8,
            "text_crc32": F.crc32(F.col("text body")),
        },
    ).drop("text body")
    keys = [F.col(f"`{c}`") for c in digest.columns]
    digest = stored(put(digest, {"virtual_slot": slot_of(*keys, slots=slots)}), "slots")
    rows = digest.groupBy("virtual_slot").agg(F.sum("size"), F.count(F.lit(1))).collect()
    loads, counts = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for slot, size, n in rows:
        loads[slot], counts[slot] = size, n
    maps = SlotMap(spark, path or new_folder(spark, "slot-map"))
    last = maps.latest()
    if last is None:
        last = 0, np.arange(slots) % shards
        maps.save(*last)
    version, owner = last
    if len(owner) != slots or owner.max() >= shards:
        raise ValueError(f"{maps.path} holds a map of {len(owner)} slots and {owner.max() + 1} shards")
    edited = rebalance(loads, grow(loads, owner, shards) if owner.max() + 1 < shards else owner, shards)
    if (edited != owner).any():
        version, owner = version + 1, edited
        maps.save(version, owner)
    first = np.zeros(slots, np.int64)
    for shard in range(shards):
        own = np.flatnonzero(owner == shard)
        first[own] = np.cumsum(counts[own]) - counts[own]
    places = spark.createDataFrame(
        [(i, int(owner[i]), int(first[i])) for i in range(slots)],
        "virtual_slot long, shard int, first_place long",
    )
    order = [F.col(f"`{c}`") for c in digest.columns if c != "virtual_slot"]
    place = F.row_number().over(W.partitionBy("virtual_slot").orderBy(*order)) - 1
    out = put(digest, {"place in slot": place}).join(F.broadcast(places), "virtual_slot")
    out = put(out, {"slot": F.col("first_place") + F.col("place in slot"), "map_version": F.lit(version)})
    return out.drop("first_place", "place in slot")
