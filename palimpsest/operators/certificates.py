"""Which hosts changed their certificates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frontier import numbered
from .history import beside


def state(captures: DataFrame) -> DataFrame:
    """Each host's last certificate, by insertion."""
    rows = captures.where("certificate_id IS NOT NULL")
    top = rows.groupBy("host_id").agg(F.max_by(F.struct("crawl_result_id", "certificate_id"), "crawl_result_id").alias("c"))
    return top.select("host_id", "c.*")


def changes(captures: DataFrame, certificates: DataFrame, alerts: bool = True) -> DataFrame:
    """A row for each capture whose host showed another certificate before, but for a move from one verified certificate to another. alerts=False: those moves."""
    shown = captures.where("certificate_id IS NOT NULL").select("host_id", "crawl_result_id", "certificate_id", F.col("ended_ms").alias("observed_ms"))
    rows = beside(shown, "host_id", ["crawl_result_id"], ["crawl_result_id", "certificate_id"])
    moved = rows.select("*", F.col("_before.crawl_result_id").alias("previous_crawl_result_id"), F.col("_before.certificate_id").alias("previous_certificate_id")).drop("_before").where("previous_certificate_id <> certificate_id")
    now = certificates.select("certificate_id", F.col("fp"), F.col("pkix_verified").alias("_now"))
    then = certificates.select(F.col("certificate_id").alias("previous_certificate_id"), F.col("fp").alias("previous_fp"), F.col("pkix_verified").alias("_then"))
    both = moved.join(now, "certificate_id").join(then, "previous_certificate_id")
    kept = both.where(~(F.col("_now") & F.col("_then"))) if alerts else both.where(F.col("_now") & F.col("_then"))
    return kept.drop("_now", "_then")


def report(changed: DataFrame, hosts: DataFrame) -> DataFrame:
    """Lines of the report, newest first, under a heading for each year."""
    time = F.timestamp_millis("observed_ms")
    rows = changed.join(hosts, "host_id").withColumns({"year": F.date_format(time, "yyyy"), "month": F.date_format(time, "yyyy-MM")})
    rows = numbered(rows.withColumn("_order", F.struct("year", (-F.col("observed_ms")).alias("t"), (-F.col("crawl_result_id")).alias("i"))), "_order", "_place")
    first = rows.groupBy("year").agg(F.min("_place").alias("_first"))  # a row for each year
    return rows.join(F.broadcast(first), "year").select("year", (F.col("_place") - F.col("_first") + 1).cast("long").alias("position"), F.concat_ws(" ", "month", "authority", F.substring("previous_fp", 1, 16), F.lit("->"), F.substring("fp", 1, 16)).alias("line"))


def name_matches(pattern, host):
    """Whether a certificate's name covers a host: itself, a wildcard's suffix, or an ancestor of at least two labels."""
    suffix = F.when(F.startswith(pattern, F.lit("*.")), F.substring(pattern, 2, 255)).otherwise(F.concat(F.lit("."), pattern))
    deep = F.size(F.split(pattern, "[.]")) >= 2
    return (pattern == host) | (deep & F.endswith(host, suffix))
