"""The table of runs, and the log of their state changes."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countercheck.operators.history import ARCHIVE, DELETE, RESTORE, RUNS, STATE_EVENTS, with_state
from countercheck.sinks import storage
from countercheck.sinks.details import DetailStore
from countercheck.sinks.packed_log import PackedLog


DONE, UNKNOWN = "done", "unknown"


def now() -> datetime:
    """UTC without a zone, which is how run times are stored."""
    return datetime.now(UTC).replace(tzinfo=None)


def new_run_id(at: datetime) -> str:
    """The day and a random part; the day says in which month a run is packed."""
    return f"{at:%Y%m%d}-{uuid.uuid4().hex}"


DATED = r"^((19|20)\d{2})(0[1-9]|1[0-2])\d{2}-"


def month_of(run_id: str) -> str | None:
    found = re.match(DATED, run_id)
    return f"{found[1]}-{found[3]}" if found else None


class RunTable:
    """Runs and changes of state are batches of two packed logs, so checks can
    record at the same time without sharing a commit, and ``pack`` keeps the
    number of files small. A run's month is that in its id, or else that of
    its start.
    """

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark = spark
        self.base = base.rstrip("/")
        self.details = DetailStore(spark, f"{self.base}/details")
        dated = F.col("run_id").rlike(DATED)
        in_id = F.concat_ws("-", F.substring("run_id", 1, 4), F.substring("run_id", 5, 2))
        month = F.when(dated, in_id).otherwise(F.date_format("started_at", "yyyy-MM"))
        self._runs = PackedLog(spark, self.base, "runs", RUNS, month)
        self._state = PackedLog(spark, self.base, "state", STATE_EVENTS, F.date_format("at", "yyyy-MM"))

    def pack(self) -> bool:
        """Put loose runs and state changes into few files, by month. Merges
        drop deleted runs for good; their DELETE stays, as another merge may
        be under way. True if anything was packed."""
        state = self._state.read()

        def kept(runs: DataFrame) -> DataFrame:
            return with_state(runs, state).drop("archived")

        return any([self._runs.pack(kept), self._state.pack()])

    def record(
        self,
        module: str,
        name: str,
        status: str,
        started_at: datetime,
        summary: Mapping[str, object] | None = None,
        source: str | None = None,
        target: str | None = None,
        error: str | None = None,
        project_id: str = "default",
        suite_id: str | None = None,
        run_id: str | None = None,
    ) -> str:
        """Append one run and return its id. An id the caller names has to be new."""
        run_id = run_id or new_run_id(started_at)
        finished = now()
        row = (
            run_id,
            module,
            name,
            status,
            json.dumps(summary or {}, default=str),
            source,
            target,
            error,
            round((finished - started_at).total_seconds(), 3),
            project_id,
            suite_id,
            started_at,
            finished,
        )
        self._runs.add(self.spark.createDataFrame([row], RUNS), run_id)
        return run_id

    def runs(self) -> DataFrame:
        """All runs that are not deleted, with ``archived``."""
        return with_state(self._runs.read(), self._state.read())

    def get(self, run_id: str):
        """One run as a Row, or None. A dated id is looked up in its month only."""
        runs = self._runs.read(month_of(run_id)).filter(F.col("run_id") == run_id)
        return with_state(runs, self._state.read().filter(F.col("run_id") == run_id)).first()

    def archive(self, run_ids: Sequence[str]) -> dict[str, str]:
        return self._change(run_ids, ARCHIVE)

    def restore(self, run_ids: Sequence[str]) -> dict[str, str]:
        return self._change(run_ids, RESTORE)

    def delete(self, run_ids: Sequence[str]) -> dict[str, str]:
        """Remove runs and their detail. The detail goes first: a run without
        detail can be deleted again, detail without a run would be lost."""
        for run_id in run_ids:
            self.details.delete(run_id)
        outcome = self._change(run_ids, DELETE)
        for run_id, what in outcome.items():
            if what == DONE:
                storage.remove(self.spark, f"{self.base}/runs/{run_id}")
        return outcome

    def _change(self, run_ids: Sequence[str], action: str) -> dict[str, str]:
        """Outcome by run id: DONE, or UNKNOWN where there is no such run."""
        if not run_ids:
            return {}
        asked = self.spark.createDataFrame([(r,) for r in dict.fromkeys(run_ids)], "run_id string")
        found = asked.join(self.runs().select("run_id"), "run_id", "left_semi")
        known = {r["run_id"] for r in found.collect()}
        if known:
            events = [(r, action, now()) for r in sorted(known)]
            self._state.add(self.spark.createDataFrame(events, STATE_EVENTS))
        return {r: DONE if r in known else UNKNOWN for r in run_ids}
