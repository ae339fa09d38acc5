"""Review decisions as a stream (ST3).

The last decision of a record is state of the query, kept by groups of records. A
decision that is older than it, or the same one again, changes nothing; a later one
replaces it and is committed, so the log grows with changes and not with deliveries. State of a record goes once the
watermark has passed its last decision: whatever is older arrives too late by then.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallysheet.operators.review import apply_decisions
from tallysheet.streaming import commits

DECISION = "decided_at timestamp, decision_id string, status string, user_id string"
COLUMNS = ("decided_at", "decision_id", "status", "user_id")
HELD = "record_id string, decided_us bigint, decision_id string, status string, user_id string"
#: Groups of records whose decisions are read and written at once; fixed for the life of a checkpoint.
GROUPS = 4096
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestDecision(StatefulProcessor):
    """The last decision of each record of a group by time and then by id.

    A call of the state store costs much more than a record, so a group has one list.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getListState("latest", HELD)

    def _known(self) -> dict[str, tuple]:
        return {row[0]: (int(row[1]), *row[2:]) for row in self.latest.get()} if self.latest.exists() else {}

    def _keep(self, known: dict[str, tuple], watermark_ms: int) -> None:
        """Decisions that the watermark has passed go; a timer is set for the next."""
        live = [(record, *best) for record, best in known.items() if best[0] > watermark_ms * 1000]
        if live:
            self.latest.put(live)
            self.handle.registerTimer(-(-min(row[1] for row in live) // 1000))
        else:
            self.latest.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, changed = self._known(), {}
        for batch in rows:
            last = batch.sort_values(["decided_at", "decision_id"]).drop_duplicates("record_id", keep="last")
            times = last["decided_at"].to_numpy("datetime64[us]").astype("int64").tolist()
            for record, *found in zip(last["record_id"], times, *(last[c] for c in COLUMNS[1:])):
                best = known.get(record)
                if best is None or tuple(found[:2]) > best[:2]:
                    known[record] = changed[record] = tuple(found)
        if changed:
            self._keep(known, timerValues.getCurrentWatermarkInMs())
            out = pd.DataFrame([(record, *best) for record, best in changed.items()], columns=["record_id", *COLUMNS])
            out["decided_at"] = pd.to_datetime(out["decided_at"], unit="us")
            yield out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Also runs for timers of decisions that later ones have replaced; nothing else goes then."""
        if self.latest.exists():
            self._keep(self._known(), timerValues.getCurrentWatermarkInMs())
        yield from ()

    def close(self) -> None:
        pass


def latest_decisions_stream(decisions: DataFrame, time: str = "decided_at", delay: str = "1 day") -> DataFrame:
    """Changes of the last decision of each record; decisions later than `delay` are dropped."""
    group = F.pmod(F.xxhash64("record_id"), F.lit(GROUPS)).cast("int")
    return (
        decisions.select("record_id", *COLUMNS, group.alias("records")).withWatermark(time, delay).groupBy("records")
        .transformWithStateInPandas(
            statefulProcessor=LatestDecision(), outputStructType=f"record_id string, {DECISION}",
            outputMode="Update", timeMode="EventTime",
        )
    )


def start_review_log(decisions: DataFrame, target: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Commit the records whose last decision changed, batch by batch, until no input is left."""
    spark = decisions.sparkSession
    commits.open_log(spark, target)
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        return (
            latest_decisions_stream(decisions, delay=delay).writeStream.outputMode("update")
            .foreachBatch(lambda batch, batch_id: commits.commit(batch, target, batch_id))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(STORE, before)


def decisions_in_force(records: DataFrame, target: str) -> DataFrame:
    """One decision per record, the one committed last."""
    rows = commits.read_commits(records.sparkSession, target)
    values = [c for c in rows.columns if c not in ("record_id", "_batch")]
    return rows.groupBy("record_id").agg(
        F.max_by(F.struct(*values, "_batch"), F.struct("_batch", "decided_at", "decision_id")).alias("d")
    ).select("record_id", "d.*")


def reviewed_records(records: DataFrame, target: str) -> DataFrame:
    """T2 with the decisions committed so far."""
    return apply_decisions(records, decisions_in_force(records, target).drop("_batch"))


def compact_review_log(records: DataFrame, target: str) -> None:
    """One row per decided record; `reviewed_records` is the same before and after."""
    commits.compact(decisions_in_force(records, target), target)
