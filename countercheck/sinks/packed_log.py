"""An append-only table of small batches that is packed into few files now and then."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countercheck.sinks import storage

MONTH = "month"
#: With this many packs, the next packing merges all into one. So a month has
#: at most this many files, however often the log is packed.
MERGE_AT = 4


class PackedLog:
    """Batches in folders of their own under ``<base>/<name>``, so writers never
    share a commit; packs, by month, under ``<base>/packed/<name>``.

    A numbered list names the packs that count and the batches they took in.
    Lists are only ever added, each as one small file that must not exist yet:
    of two packers at once, one wins and the other undoes its work. (Object
    stores that can't refuse to overwrite need one packer at a time.) What a
    list supersedes is removed by the packing after it, so readers that have
    planned meanwhile still find their files.
    """

    def __init__(
        self, spark: SparkSession, base: str, name: str, schema: T.StructType, month: Column
    ) -> None:
        self.spark, self.schema, self.month = spark, schema, month
        self.loose, self.packed = f"{base}/{name}", f"{base}/packed/{name}"

    def add(self, rows: DataFrame, batch: str | None = None) -> None:
        """Write a batch. One of the same name that is still loose is replaced;
        one that a pack took in is not, and the log then has both."""
        batch = batch or uuid.uuid4().hex
        if batch in self._list()[1]["taken"]:
            batch = f"{batch}-{uuid.uuid4().hex}"
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.loose}/{batch}")

    def _list(self) -> tuple[int, dict]:
        """The highest number given, and the content of the newest list. One
        that is still being written, or was left so, does not count yet."""
        numbers = sorted(int(n.split(".")[0]) for n in storage.matches(self.spark, f"{self.packed}/lists/*.json"))
        for number in reversed(numbers):
            try:
                return numbers[-1], json.loads(storage.read_text(self.spark, self._list_path(number)))
            except json.JSONDecodeError:
                continue
        return max(numbers, default=0), {"packs": [], "taken": [], "superseded": []}

    def _list_path(self, number: int) -> str:
        return f"{self.packed}/lists/{number:08d}.json"

    def _batches(self, taken: list[str]) -> list[str]:
        """Whole batches that are not in a pack."""
        written = storage.matches(self.spark, f"{self.loose}/*/_SUCCESS", parent=True)
        return sorted(set(written) - set(taken))

    def _rows(self, batches: list[str], packs: list[str], month: str | None = None) -> DataFrame:
        parts = []
        if batches:
            loose = [f"{self.loose}/{b}" for b in batches]
            parts.append(self.spark.read.schema(self.schema).parquet(*loose))
        schema = T.StructType([*self.schema.fields, T.StructField(MONTH, T.StringType())])
        for pack in packs:  # MERGE_AT at most
            rows = self.spark.read.schema(schema).parquet(f"{self.packed}/{pack}")
            rows = rows if month is None else rows.filter(F.col(MONTH) == month)
            parts.append(rows.select(*self.schema.names))
        return reduce(DataFrame.unionByName, parts or [self.spark.createDataFrame([], self.schema)])

    def read(self, month: str | None = None) -> DataFrame:
        """All rows; with ``month``, only that month of what is packed is read."""
        _, now = self._list()
        return self._rows(self._batches(now["taken"]), now["packs"], month)

    def pack(self, kept: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> bool:
        """Pack the loose batches, and all packs once there are ``MERGE_AT``; a
        merge leaves out rows that are not ``kept``. False if there was nothing
        to do, or if another packer was first."""
        number, now = self._list()
        batches = self._batches(now["taken"])
        if not batches:
            return False
        merge = len(now["packs"]) >= MERGE_AT
        rows = self._rows(batches, now["packs"] if merge else [])
        pack = uuid.uuid4().hex
        (
            (kept(rows) if merge else rows)
            .withColumn(MONTH, self.month)
            .repartition(MONTH)
            .sortWithinPartitions(MONTH, self.schema.names[0])
            .write.partitionBy(MONTH)
            .parquet(f"{self.packed}/{pack}")
        )
        after = {
            "packs": [pack] if merge else [*now["packs"], pack],
            "taken": batches,
            "superseded": now["packs"] if merge else [],
        }
        if not storage.write_new_text(self.spark, self._list_path(number + 1), json.dumps(after)):
            storage.remove(self.spark, f"{self.packed}/{pack}")
            return False
        for path in [f"{self.loose}/{b}" for b in now["taken"]] + [f"{self.packed}/{p}" for p in now["superseded"]]:
            storage.remove(self.spark, path)
        return True
