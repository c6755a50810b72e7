"""The change feed and the certificate watch over a stream of captures.

Captures must come in the order of their commits, which a writer's clock guarantees (it never runs backwards); within a
micro-batch they are put in order here. State is a row for each page or host.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.history import VERSION
from ..schema import ALL_MODES
from ..session import ship

CAPTURE = "crawl_result_id long, page_id long, host_id long, redirected_to_page_id long, redirect_count long, certificate_id long, ended_ms long, committed_ms long, status_code long, robots_bitfield long, object_id long, raw_bytes long, meta string"
COLUMNS = [c.split(" ")[0] for c in CAPTURE.split(", ")]
LONGS = [c for c in COLUMNS if c != "meta"]


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["committed_ms", "crawl_result_id"], kind="stable")


def _versions(pdf: pd.DataFrame) -> pd.Series:
    """What of each row is its content, as a text that is equal where that is."""
    cols = [pdf[c].map(repr) if c == "meta" else pdf[c].astype("Int64").astype(str) for c in VERSION]
    out = cols[0]
    for c in cols[1:]:
        out = out + "\x1f" + c
    return out


def stream_events(captures: DataFrame) -> DataFrame:
    """captures (a stream) with update_bitfield, as the batch operator gives it. A page's rows of a micro-batch are compared as columns."""
    ship(captures.sparkSession)

    def step(key, frames, state):
        robots, version = state.get if state.exists else (0, None)
        pdf = _in_order(frames)
        for c in LONGS:
            pdf[c] = pdf[c].astype("Int64")
        new, now = pdf["robots_bitfield"].astype("int64"), _versions(pdf.assign(meta=pdf["meta"].where(pdf["meta"].notna(), None)))
        old, before = new.shift(1, fill_value=robots), now.shift(1, fill_value=version)
        state.update((int(new.iloc[-1]), now.iloc[-1]))
        pdf["update_bitfield"] = ((new ^ old) | (new & old).where(now != before, 0)) & ALL_MODES
        yield pdf[[*COLUMNS, "update_bitfield"]]

    return captures.select(COLUMNS).groupBy("page_id").applyInPandasWithState(step, CAPTURE + ", update_bitfield long", "robots long, version string", "append", GroupStateTimeout.NoTimeout)


def stream_certificate_changes(captures: DataFrame, certificates: DataFrame | None = None) -> DataFrame:
    """Alerts of a stream: host, capture, its certificate and the one before; none between two that certificates (certificate_id, pkix_verified; a table, joined as it is at each batch) has as verified."""
    ship(captures.sparkSession)

    def step(key, frames, state):
        pdf = pd.concat(list(frames)).sort_values("crawl_result_id")
        last = state.get if state.exists else (None, None)
        ids, shown = pdf["crawl_result_id"].astype("Int64"), pdf["certificate_id"].astype("Int64")
        out = pd.DataFrame({"host_id": key[0], "crawl_result_id": ids, "certificate_id": shown, "previous_crawl_result_id": ids.shift(1), "previous_certificate_id": shown.shift(1), "observed_ms": pdf["ended_ms"].astype("Int64")})
        if last[0] is not None:
            out.iloc[0, 3], out.iloc[0, 4] = last
        state.update((int(ids.iloc[-1]), int(shown.iloc[-1])))
        yield out[(out["previous_certificate_id"] != out["certificate_id"]).fillna(False)]

    schema = "host_id long, crawl_result_id long, certificate_id long, previous_crawl_result_id long, previous_certificate_id long, observed_ms long"
    rows = captures.where("certificate_id IS NOT NULL").select("host_id", "crawl_result_id", "certificate_id", "ended_ms")
    moved = rows.groupBy("host_id").applyInPandasWithState(step, schema, "crawl_result_id long, certificate_id long", "append", GroupStateTimeout.NoTimeout)
    if certificates is None:
        return moved
    now = certificates.select("certificate_id", F.col("pkix_verified").alias("_now"))
    then = certificates.select(F.col("certificate_id").alias("previous_certificate_id"), F.col("pkix_verified").alias("_then"))
    both = moved.join(now, "certificate_id", "left").join(then, "previous_certificate_id", "left")
    return both.where(~(F.coalesce("_now", F.lit(False)) & F.coalesce("_then", F.lit(False)))).select(moved.columns)


def write_batches(stream: DataFrame, place: str, checkpoint: str):
    """A query that writes each micro-batch to a folder of its own, so that one that runs again replaces itself."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{place}/batch={batch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

