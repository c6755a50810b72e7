"""Keyed state over streams: running totals of the archive, and schedules that fall due.

State is Spark's own, a row for each member or schedule, and needs a state store that keeps it on disk (``use_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.history import KINDS, members_of
from ..session import ship
from ..sources.store import Merge, Store

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """The state store that stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


# running totals


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each member of a batch of rows, with its bytes added up, so that a frequent host sends few rows on."""
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by(["kind", "id"]).aggregate([("raw_bytes", "sum")])
        yield from pa.table({"kind": t["kind"], "id": t["id"], "raw_bytes": t["raw_bytes_sum"].fill_null(0)}).to_batches()


class _Members(StatefulProcessor):
    """Tells a member once, when it first comes, and the bytes of its rows each time."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        size, new = sum(int(r["raw_bytes"].sum()) for r in rows), not self.seen.exists()
        if new:
            self.seen.update((1,))
        if new or size:
            yield pd.DataFrame({"kind": [key[0]], "members": [int(new)], "raw_bytes": [size]})

    def close(self) -> None:
        pass


def new_members(captures: DataFrame) -> DataFrame:
    """kind (page, host, object), members (1 for one that is new) and raw_bytes, of a stream of captures: what its statistics go up by."""
    ship(captures.sparkSession)
    rows = members_of(captures).mapInArrow(_summed, "kind string, id long, raw_bytes long")
    return rows.groupBy("kind", "id").transformWithStateInPandas(_Members(), "kind string, members long, raw_bytes long", "Update", "None")


def keep_totals(captures: DataFrame, store: Store, checkpoint: str, table: str = "totals", writer: str = "totals"):
    """A query that adds what each micro-batch of captures brings to the totals of a store: kind, members and raw_bytes, a row for each kind.

    A batch is added as one commit that knows its number, so one that runs again after a failure adds nothing twice.
    """

    def add(df: DataFrame, batch: int) -> None:
        old = store.manifest()
        if batch <= old["writers"].get(writer, -1):
            return
        more = df.groupBy("kind").agg(F.sum("members").alias("members"), F.sum("raw_bytes").alias("raw_bytes"))
        before = store.read(table, manifest=old)
        both = more if before is None else before.select(more.columns).unionByName(more)
        sums = both.groupBy("kind").agg(F.sum("members").alias("members"), F.sum("raw_bytes").alias("raw_bytes"))  # a row for each kind
        store.commit({table: Merge(sums)}, writer, batch, base=old["version"])

    return new_members(captures).writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def as_statistics(totals: DataFrame) -> DataFrame:
    """Totals as the one row of history.statistics."""
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0)).cast("long")
    return totals.agg(of("page", "members").alias("archived_pages"), of("page", "raw_bytes").alias("uncompressed_bytes"), of("host", "members").alias("archive_hosts"), of("object", "members").alias("archive_objects"))


assert KINDS == ("page", "host", "object")

# schedules

#: kind: schedule (sets next_ms), decide (from expected_ms to next_ms), drop, or tick (tells the time alone). at: when the message is from; the latest one is what time it is.
MESSAGES = "page_id long, automatic long, kind string, expected_ms long, next_ms long, at timestamp"
_NEWS = "page_id long, automatic long, news string, at_ms long"


class _Schedules(StatefulProcessor):
    """A schedule's time, and a timer that fires then. Messages of a batch are taken by their time; of one time, schedules come before decisions."""

    def init(self, handle) -> None:
        self.handle, self.next = handle, handle.getValueState("next", "at_ms long")

    def _set(self, at: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if at is None:
            self.next.clear()
        else:
            self.next.update((at,))
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        messages = pd.concat(list(rows))
        rank = messages["kind"].map({"schedule": 0, "decide": 1, "drop": 2, "tick": 3})
        for m in messages.assign(_rank=rank).sort_values(["at", "_rank", "next_ms"], kind="stable").itertuples():
            if m.kind == "schedule":
                self._set(int(m.next_ms))
            elif m.kind == "drop":
                self._set(None)
            elif m.kind == "decide":
                holds = self.next.exists() and self.next.get()[0] == m.expected_ms
                if holds:
                    self._set(int(m.next_ms))
                out.append((key[0], key[1], "applied" if holds else "refused", int(m.next_ms)))
        yield pd.DataFrame(out, columns=["page_id", "automatic", "news", "at_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.next.get()[0] if self.next.exists() else None
        rows = [(key[0], key[1], "due", at)] if at == expiredTimerInfo.getExpiryTimeInMs() else []
        yield pd.DataFrame(rows, columns=["page_id", "automatic", "news", "at_ms"])

    def close(self) -> None:
        pass


def due_schedules(messages: DataFrame) -> DataFrame:
    """page_id, automatic, news and at_ms: a schedule that falls due, once, at its time; and of each decision whether it was applied or refused.

    A decision takes effect only if the schedule still has the time that it expects, so of two that expect the same one is refused. messages: a stream of MESSAGES. The time is
    the latest that any message has, so nothing is due before its time, and ticks make it go on where nothing else comes.
    """
    ship(messages.sparkSession)
    keyed = messages.withWatermark("at", "0 seconds").groupBy("page_id", "automatic")
    return keyed.transformWithStateInPandas(_Schedules(), _NEWS, "Append", "EventTime")
