"""The change feed of an audience: what it must add or drop since a cursor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mime import ascii_lower, body_matches
from ..schema import BATCH_BYTES
from .history import clamp

def mime_passes(filters: list[str]) -> Column:
    """Whether an upsert passes the lenient filter on the text before a semicolon; * stands for any run."""
    if not filters or "*" in filters:
        return F.lit(True)
    kind = ascii_lower(F.trim(F.split_part(F.coalesce("meta", F.lit("")), F.lit(";"), F.lit(1))))
    out = F.lit(False)
    for f in filters:
        pattern = f.replace("\\", "\\\\").replace("_", "\\_").replace("%", "\\%").replace("*", "%")
        out |= kind.like(pattern)
    return out | (F.col("status_code").between(30, 39) & F.col("redirected_to_page_id").isNotNull())


def feed(events: DataFrame, use: int, after: tuple[int, int] = (0, 0), through: int | None = None, mimes: list[str] = (), max_bytes: int | None = None, cursor: tuple[int, int] | None = None) -> DataFrame:
    """News for an audience after a (commit time, id) and up to a time, both by key range; removal marks what it must drop. Removals pass every filter.

    events: captures with update_bitfield, which is worth keeping as a table in order of commit time, so that ranges are found from file statistics.
    """
    c, i = F.col("committed_ms"), F.col("crawl_result_id")
    rows = events.where((F.col("update_bitfield").bitwiseAND(use) != 0) & ((c > after[0]) | ((c == after[0]) & (i > after[1]))))
    if through is not None:
        rows = rows.where(c <= through)
    if cursor is not None:
        rows = rows.where((c < cursor[0]) | ((c == cursor[0]) & (i <= cursor[1])))
    rows = rows.withColumn("removal", F.col("robots_bitfield").bitwiseAND(use) == 0)
    rows = rows.where(F.col("removal") | mime_passes(list(mimes)))
    return rows if max_bytes is None else rows.where(F.col("removal") | F.col("raw_bytes").isNull() | (F.col("raw_bytes") <= max_bytes))


def page(rows: DataFrame, limit: int = 500) -> DataFrame:
    """The first rows of a feed in order, with position and has_more."""
    limit = clamp(limit)
    top = rows.orderBy("committed_ms", "crawl_result_id").limit(limit + 1)
    w = Window.orderBy("committed_ms", "crawl_result_id")  # over limit + 1 rows
    return top.withColumns({"position": F.row_number().over(w).cast("long"), "has_more": F.count("*").over(Window.partitionBy()) > limit}).where(F.col("position") <= limit)


def budget(rows: DataFrame, most: int = BATCH_BYTES, filters: list[str] | None = None) -> DataFrame:
    """The rows of a page whose bodies fit a budget, in order; the first always does. filters: only bodies that pass them count. rows: a page, so of bounded size."""
    w = Window.orderBy("committed_ms", "crawl_result_id")
    counts = F.lit(True) if filters is None else included(filters)
    held = F.sum(F.when(counts, F.coalesce("raw_bytes", F.lit(0))).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"total_bytes": held.cast("long"), "_n": F.row_number().over(w)}).where((F.col("total_bytes") <= most) | (F.col("_n") == 1)).drop("_n")


def included(filters: list[str]) -> Column:
    """Whether a row's body goes into a batch: an upsert with a body of a type that is asked for."""
    return ~F.col("removal") & F.col("object_id").isNotNull() & body_matches("meta", filters)


def manifest(rows: DataFrame, filters: list[str]) -> DataFrame:
    """What becomes of each row's body in a batch."""
    state = F.when(F.col("removal"), "removed").when(F.col("object_id").isNull(), "unavailable").when(body_matches("meta", filters), "included").otherwise("excluded_by_body_mime")
    return rows.withColumn("body_state", state)


#: Names of a result's fields, and the columns that they are of. Fields without a value are left out; a redirect is told as it was received.
FIELDS = {
    "body_blake2b_256": "body_digest", "body_bytes": "body_bytes", "certificate_blake2b_256": "certificate_digest", "committed_at_unix_millis": "committed_ms", "crawl_result_id": "crawl_result_id", "ended_at_unix_millis": "ended_ms", "meta": "meta",
    "redirect_count": "redirect_count", "redirected_to": "redirected_to", "started_at_unix_millis": "started_ms", "status_code": "status_code", "url": "url",
}
OF_REMOVAL = ("committed_at_unix_millis", "crawl_result_id", "url")


def _json(names, action: str | None, more: dict[str, Column]) -> Column:
    """An object with its fields in the order of their names."""
    fields = {n: F.col(FIELDS[n]) for n in names} | ({"action": F.lit(action)} if action else {}) | more
    return F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)]))


def _with_values(rows: DataFrame) -> DataFrame:
    """rows (a result's columns, redirect_url, and hexadecimal body_digest and certificate_digest) with what a result tells."""
    return rows.withColumns({"redirected_to": F.when(F.col("redirect_url").isNotNull(), F.coalesce("meta", "redirect_url")), "body_bytes": F.when(F.col("body_digest").isNotNull(), F.col("raw_bytes"))})


def result_json(rows: DataFrame) -> DataFrame:
    """crawl_result_id and json: results in full, by all clocks and digests."""
    return _with_values(rows).select("crawl_result_id", _json(FIELDS, None, {}).alias("json"))


def as_json(rows: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """crawl_result_id and json of feed rows: an upsert is the result in full, a removal only what names it. more: further fields of each."""
    more = more or {}
    made = F.when(F.col("removal"), _json(OF_REMOVAL, "remove", more)).otherwise(_json(FIELDS, "upsert", more))
    return _with_values(rows).select("crawl_result_id", made.alias("json"))


def warc_target(url: Column) -> Column:
    """The address of a body's record: the page's, without a fragment."""
    return F.split_part(url, F.lit("#"), F.lit(1))


def batch_document(rows: DataFrame, filters: list[str], mode: str, token: Column, next_token: Column, last: tuple[int, int], form: str = "palimpsest-warc-batch-1") -> DataFrame:
    """One row: a batch's manifest as json, the time of its final row (committed_ms), final_id, and has_more.

    rows: a page within its budget, of at most MOST_ROWS rows, with a result's columns and body_state; last: the row that the batch was to end with. next_token (of the columns c and i: the final row) is told
    only where the budget ended the batch before that.
    """
    target = {"body_state": F.col("body_state"), "warc_target_uri": F.when(F.col("body_state") == "included", warc_target(F.col("url")))}
    told = rows.join(as_json(rows, target), "crawl_result_id").agg(F.array_sort(F.collect_list(F.struct("committed_ms", "crawl_result_id", "json"))).alias("l"))
    told = told.where(F.size("l") > 0).select("l", F.element_at("l", -1)["committed_ms"].alias("c"), F.element_at("l", -1)["crawl_result_id"].alias("i"))
    told = told.withColumn("has_more", F.struct("c", "i") < F.struct(F.lit(last[0]).cast("long").alias("c"), F.lit(last[1]).cast("long").alias("i")))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    text = F.concat(
        F.lit('{"batch_token":'), quoted(token), F.lit(f',"format":"{form}","mode":"{mode}","next_batch_token":'), F.when(F.col("has_more"), quoted(next_token)).otherwise(F.lit("null")), F.lit(',"results":['), F.array_join(F.transform("l", lambda x: x["json"]), ","), F.lit("]}")
    )
    return told.select(text.alias("json"), F.col("c").alias("committed_ms"), F.col("i").alias("final_id"), "has_more")
