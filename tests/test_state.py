"""Keyed state over streams: totals after each micro-batch, schedules against a clock that the test moves."""

import datetime

import pytest

from palimpsest.operators import history
from palimpsest.sources import captures as src
from palimpsest.sources.store import Store
from palimpsest.streaming import events, state


@pytest.fixture(autouse=True)
def store_provider(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state.use_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_totals_after_each_batch(spark, sf, tmp_path):
    batch = src.captures(spark, sf).select(events.COLUMNS)
    store = Store(spark, f"file://{tmp_path}/totals", {"totals": "kind"}, 2)
    (lo,) = batch.approxQuantile("committed_ms", [0.4], 0.0)
    stream = lambda: spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for part in (batch.where(f"committed_ms <= {lo}"), batch.where(f"committed_ms > {lo}")):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        state.keep_totals(stream(), store, str(tmp_path / "cp")).awaitTermination()
        rebuilt = history.statistics(spark.read.schema(batch.schema).parquet(str(tmp_path / "in"))).first()
        assert state.as_statistics(store.read("totals")).first() == rebuilt and rebuilt.archived_pages > 0
    version = store.manifest()["version"]
    store.commit({}, "totals", 0)  # a batch that is run again
    assert store.manifest()["version"] == version == 2


class Clock:
    """Messages in files, one after another, and what comes of them."""

    def __init__(self, spark, place):
        self.spark, self.place, self.k, self.seen = spark, place, 0, 0
        self._put([(-1, -1, "tick", None, None, 0)])
        stream = spark.readStream.schema(state.MESSAGES).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
        self.query = state.due_schedules(stream).writeStream.format("memory").queryName("news").outputMode("append").option("checkpointLocation", f"{place}/cp").start()

    def _put(self, rows):
        at = lambda ms: datetime.datetime.fromtimestamp(ms / 1000, datetime.UTC)
        self.spark.createDataFrame([(*r[:5], at(r[5])) for r in rows], state.MESSAGES).coalesce(1).write.mode("append").parquet(f"{self.place}/in")

    def __call__(self, *rows):
        self._put(rows)
        self.query.processAllAvailable()
        news = sorted(map(tuple, self.spark.table("news").collect()))
        new = [x for x in news if x not in self.last] if self.seen else news
        self.last, self.seen = news, 1
        return new


def test_schedules_fall_due(spark, tmp_path):
    say = Clock(spark, str(tmp_path))
    tick = lambda ms: (-1, -1, "tick", None, None, ms)
    try:
        assert say((1, 0, "schedule", None, 5000, 1000), (2, 1, "schedule", None, 9000, 1000), (3, 0, "schedule", None, 4000, 1000)) == []
        assert say(tick(4500)) == [(3, 0, "due", 4000)]
        assert say((3, 0, "drop", None, None, 4600), tick(4999)) == []
        assert say(tick(6000)) == [(1, 0, "due", 5000)]
        # two decide on the same schedule: one wins, the other is refused, and so is one on a schedule that has gone
        assert say((1, 0, "decide", 5000, 7000, 6100), (1, 0, "decide", 5000, 8000, 6100), (3, 0, "decide", 4000, 8000, 6100)) == [(1, 0, "applied", 7000), (1, 0, "refused", 8000), (3, 0, "refused", 8000)]
        assert say((2, 1, "decide", 9000, 6500, 6200)) == [(2, 1, "applied", 6500)]
        assert say(tick(7500)) == [(1, 0, "due", 7000), (2, 1, "due", 6500)]
        assert say(tick(20_000)) == []
    finally:
        say.query.stop()
