"""The write side: captures are appended in commit order with their change events, and feeds are ranges of that table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from .history import VERSION, beside, event_bits, running_max, violations

#: What a page's next capture is compared with.
LAST = ("robots_bitfield", *VERSION)


def heads(events: DataFrame) -> DataFrame:
    """Each page's last committed capture: what appending needs to know of all earlier ones."""
    own = F.struct("committed_ms", "crawl_result_id", *LAST)
    return events.groupBy("page_id").agg(F.max_by(own, F.struct("committed_ms", "crawl_result_id")).alias("c")).select("page_id", "c.*")


def committed(incoming: DataFrame, now: int, last: int) -> DataFrame:
    """incoming with committed_ms by a clock that never runs backwards: the latest of a row's own time, all before it and the table's last."""
    return running_max(incoming.withColumn("_at", F.greatest(F.coalesce("ended_ms", F.lit(now)), F.lit(last))), "crawl_result_id", "_at", "committed_ms").drop("_at")


def append(head: DataFrame, incoming: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """The event rows of new captures, compared with the captures before them in commit order: their pages' heads, and each other. A row that breaks a rule is an error.

    The one shuffle by page has the new rows and their pages' heads alone. A late row, committed before its page's head, is compared with its true predecessor in events, the table so far:
    of the captures of late rows' pages up to the latest of them, by the order of commits. The events of captures after a late one stay as they were. Without events a late row is an error.
    """
    bad = violations(incoming).select("crawl_result_id", "violation")
    checked = incoming.join(bad.select("crawl_result_id", F.col("violation").alias("_why")), "crawl_result_id", "left").select(*incoming.columns, "_why")
    checked = checked.where(F.when(F.col("_why").isNotNull(), F.raise_error(F.concat(F.lit("refused: "), "_why")).cast("boolean")).otherwise(True)).drop("_why")
    order, known = ["committed_ms", "crawl_result_id"], ["committed_ms", "crawl_result_id", *LAST]
    own = beside(checked, "page_id", order, known).join(head.select("page_id", F.struct(*known).alias("_head")), "page_id", "left")
    at, place = F.struct(*order), lambda c: F.struct(*[F.col(f"{c}.{x}") for x in order])
    late = F.col("_head").isNotNull() & (place("_head") >= at)
    if events is None:
        stop = F.raise_error(F.concat(F.lit("late capture "), F.col("crawl_result_id").cast("string"), F.lit(": its page has later ones"))).cast("boolean")
        rows = own.where(F.when(late, stop).otherwise(True)).withColumn("_old", F.col("_head"))
    else:
        found = predecessors(kept(own.where(late).select("page_id", *order), "late"), events, known)
        rows = own.join(found.select("crawl_result_id", F.col("_before").alias("_found")), "crawl_result_id", "left").withColumn("_old", F.when(late, F.col("_found")).otherwise(F.col("_head")))
    newer = F.when(F.col("_old").isNull() | (F.col("_before").isNotNull() & (place("_before") > place("_old"))), F.col("_before")).otherwise(F.col("_old"))
    return rows.withColumn("_before", newer).withColumn("update_bitfield", event_bits()).select(*incoming.columns, "update_bitfield")


def predecessors(late: DataFrame, events: DataFrame, columns: list[str]) -> DataFrame:
    """late (page_id, committed_ms, crawl_result_id) with _before: columns of the event before each in its page's commit order.

    Events are read up to the latest row's time, a range of the table, and only those of late rows' pages go on.
    """
    last = late.agg(F.max("committed_ms")).first()[0]
    rows = events.where(F.col("committed_ms") <= (last if last is not None else -1)).join(late.select("page_id").distinct(), "page_id", "left_semi").select("page_id", *columns).withColumn("_event", F.lit(True))
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns if c not in late.columns]
    both = rows.unionByName(late.select("page_id", "committed_ms", "crawl_result_id", *none, F.lit(False).alias("_event")))
    return beside(both, "page_id", ["committed_ms", "crawl_result_id"], columns, valid="_event").where("NOT _event").select("page_id", "crawl_result_id", "_before")


def write_events(events: DataFrame, place: str, mode: str = "append") -> None:
    """Adds event rows in commit order: ranges of it are files, whose statistics tell readers what to skip."""
    events.repartitionByRange("committed_ms", "crawl_result_id").sortWithinPartitions("committed_ms", "crawl_result_id").write.mode(mode).parquet(place)

