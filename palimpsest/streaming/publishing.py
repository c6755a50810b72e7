"""Batches of fetches published as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import publish
from ..sources.store import Store

Batch = tuple[DataFrame, DataFrame, DataFrame, int]


def publish_stream(stream: DataFrame, store: Store, checkpoint: str, prepare: Callable[[DataFrame], Batch], writer: str = "crawler"):
    """A query that publishes each micro-batch of a stream as one commit of all tables. prepare: a micro-batch's fetches, robots captures, bodies and the time.

    A micro-batch that runs again after a failure is known by its number and changes nothing. One that is refused stops the query with nothing of it committed; its claims stay claimed until the
    store is opened anew.
    """

    def put(df: DataFrame, batch: int) -> None:
        publish.publish(store, *prepare(df), writer, batch)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
