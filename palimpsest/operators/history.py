"""Change events, as-of retrieval and page history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ALL_MODES, MOST_ROWS
from ..session import kept

#: Rows of a key beyond which its order is cut in slices, of a quarter of that.
HOT_ROWS = 1 << 18
VERSION = ("object_id", "redirected_to_page_id", "redirect_count", "status_code", "meta")


def clamp(limit: int) -> int:
    return max(1, min(MOST_ROWS, limit))


def eligible(captures: DataFrame, use: int) -> DataFrame:
    """Captures that an audience may see."""
    return captures.where(F.col("robots_bitfield").bitwiseAND(use) != 0)


def beside(df: DataFrame, key: str, order: list[str], before: list[str] = (), after: list[str] = (), valid: str | None = None) -> DataFrame:
    """df with _before and _after: those columns of the row before and after each in its key's order, as structs, null where there is none. valid: a boolean column; only rows that have it count.

    One window by key, but for keys of more than HOT_ROWS rows. Their rows are dealt by ranges of (key, order), so that each task has a slice of a key's order, and written. Rows are compared
    within their slice; each slice's last and first rows go to the slices beside it by a table of a row for each slice. So no task has all rows of a frequent key. Keys aren't null.
    """

    def over(rows: DataFrame, w, last, first) -> dict[str, Column]:
        take = lambda cols: F.struct(*cols) if valid is None else F.when(F.col(valid), F.struct(*cols))
        back, on = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
        out = {}
        if before:
            out[last] = F.lag(take(before)).over(w) if valid is None else F.last(take(before), ignorenulls=True).over(back)
        if after:
            out[first] = F.lead(take(after)).over(w) if valid is None else F.first(take(after), ignorenulls=True).over(on)
        return out

    hot = df.groupBy(key).count().where(F.col("count") > HOT_ROWS).collect()  # a row for HOT_ROWS rows, at most
    plain = lambda rows: rows.withColumns(over(rows, Window.partitionBy(key).orderBy(*order), "_before", "_after"))
    if not hot:
        return plain(df)
    keys = F.broadcast(df.sparkSession.createDataFrame([(r[0],) for r in hot], df.select(key).schema))
    slices = -(-4 * sum(r[1] for r in hot) // HOT_ROWS)
    rows = kept(df.join(keys, key, "left_semi").repartitionByRange(slices, key, *order).withColumn("_slice", F.spark_partition_id()), "slices")
    within = rows.withColumns(over(rows, Window.partitionBy(key, "_slice").orderBy(*order), "_before", "_after"))
    counted = F.lit(True) if valid is None else F.col(valid)
    place = F.when(counted, F.struct(*order))
    ends = rows.groupBy(key, "_slice").agg(*[x for x in ([F.max_by(F.struct(*before), place).alias("_last")] if before else []) + ([F.min_by(F.struct(*after), place).alias("_first")] if after else [])])
    chain = Window.partitionBy(key).orderBy("_slice")  # a row for each slice
    carried = ends.select(key, "_slice", *([F.last("_last", ignorenulls=True).over(chain.rowsBetween(Window.unboundedPreceding, -1)).alias("_from")] if before else []), *([F.first("_first", ignorenulls=True).over(chain.rowsBetween(1, Window.unboundedFollowing)).alias("_to")] if after else []))
    both = within.join(carried, [key, "_slice"])
    joined = both.withColumns(({"_before": F.coalesce("_before", "_from")} if before else {}) | ({"_after": F.coalesce("_after", "_to")} if after else {}))
    cold = plain(df.join(keys, key, "left_anti"))
    return cold.unionByName(joined.select(cold.columns)).select(*df.columns, *(["_before"] if before else []), *(["_after"] if after else []))


def _same(columns=VERSION) -> Column:
    """Whether a row has the content of the row before it."""
    out = F.lit(True)
    for c in columns:
        out &= F.col(c).eqNullSafe(F.col(f"_before.{c}"))
    return out


def event_bits() -> Column:
    """update_bitfield of a row beside _before (robots_bitfield and VERSION)."""
    old, new = F.coalesce("_before.robots_bitfield", F.lit(0)), F.col("robots_bitfield")
    changed = F.when(_same(), F.lit(0)).otherwise(new.bitwiseAND(old))
    return new.bitwiseXOR(old).bitwiseOR(changed).bitwiseAND(ALL_MODES).cast("long")


def with_events(captures: DataFrame) -> DataFrame:
    """Adds update_bitfield: for each audience, whether this capture is news against the page's previous one, which it may see or not.

    A bit is set where permission changed, or where it stayed and the content did not. One shuffle, by page, unless a page has very many captures.
    """
    rows = beside(captures, "page_id", ["committed_ms", "crawl_result_id"], ["robots_bitfield", *VERSION])
    return rows.withColumn("update_bitfield", event_bits()).drop("_before")


def as_of(captures: DataFrame, use: int, at: int | None = None) -> DataFrame:
    """Each page's newest visible capture by commit time, at a time or now. Summed before the shuffle, so a page of many captures is no burden."""
    rows = eligible(captures, use)
    if at is not None:
        rows = rows.where(F.col("committed_ms") <= at)
    top = rows.groupBy("page_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "page_id"]), F.struct("committed_ms", "crawl_result_id")).alias("c"))
    return top.select("page_id", "c.*").select(captures.columns)


def archive(captures: DataFrame, page_id: int, use: int, before: tuple[int, int] | None = None, limit: int = 100) -> DataFrame:
    """A page's visible captures, newest start first, from a cursor (started, id) on; id 0 is no cursor."""
    rows = eligible(captures, use).where(F.col("page_id") == page_id)
    if before and before[1]:
        rows = rows.where((F.col("started_ms") < before[0]) | ((F.col("started_ms") == before[0]) & (F.col("crawl_result_id") < before[1])))
    return rows.orderBy(F.desc("started_ms"), F.desc("crawl_result_id")).limit(clamp(limit))


def capture(captures: DataFrame, page_id: int, crawl_result_id: int, use: int) -> DataFrame:
    return eligible(captures, use).where((F.col("page_id") == page_id) & (F.col("crawl_result_id") == crawl_result_id))


def with_neighbors(captures: DataFrame, use: int) -> DataFrame:
    """Visible captures with previous_id and next_id by start time."""
    one = ["crawl_result_id"]
    rows = beside(eligible(captures, use), "page_id", ["started_ms", "crawl_result_id"], one, one)
    return rows.withColumns({"previous_id": F.col("_before.crawl_result_id"), "next_id": F.col("_after.crawl_result_id")}).drop("_before", "_after")


def timeline(captures: DataFrame, use: int) -> DataFrame:
    """Visible captures that differ from the one before: the first of each unchanged run."""
    rows = beside(eligible(captures, use), "page_id", ["started_ms", "crawl_result_id"], list(VERSION))
    return rows.where(F.col("_before").isNull() | ~_same()).drop("_before")


def latest(captures: DataFrame) -> DataFrame:
    """Each page's last inserted capture, visible or not."""
    return captures.groupBy("page_id").agg(F.max("crawl_result_id").alias("latest_crawl_result_id"))


def projection(captures: DataFrame, pages: DataFrame, certificates: DataFrame | None = None) -> DataFrame:
    """The result row: a capture with its page and, where there are any, redirect target and certificate."""
    target = pages.select(F.col("page_id").alias("redirected_to_page_id"), F.col("url").alias("redirect_url"))
    out = captures.join(pages.select("page_id", "url"), "page_id").join(target, "redirected_to_page_id", "left")
    return out if certificates is None else out.join(certificates, "certificate_id", "left")


def history_lines(captures: DataFrame, pages: DataFrame, use: int) -> DataFrame:
    """A page's history as text lines, newest first: position, heading (at a new year), gap (before a new month of the same year) and line."""
    rows = timeline(captures, use).join(pages.select("page_id", "url"), "page_id")
    w = Window.partitionBy("page_id").orderBy(F.desc("started_ms"), F.desc("crawl_result_id"))
    time = F.timestamp_millis("ended_ms")
    rows = rows.withColumns({"year": F.date_format(time, "yyyy"), "month": F.date_format(time, "yyyy-MM"), "day": F.date_format(time, "yyyy-MM-dd")})
    new_year = ~F.col("year").eqNullSafe(F.lag("year").over(w))
    mime = F.translate(F.coalesce("meta", F.lit("application/octet-stream")), "\r\n", "  ")
    return rows.select(
        "page_id",
        F.row_number().over(w).cast("long").alias("position"),
        F.when(new_year, F.concat(F.lit("### "), "year")).alias("heading"),
        (~new_year & ~F.col("month").eqNullSafe(F.lag("month").over(w))).alias("gap"),
        F.concat(F.lit("=> "), "url", F.lit("/version/"), F.col("crawl_result_id").cast("string"), F.lit(" "), "day", F.lit("  "), mime).alias("line"),
    )


def statistics(captures: DataFrame) -> DataFrame:
    """What the archive holds for archiving: pages, bytes (of every capture, not of distinct objects), hosts, objects. One row."""
    return eligible(captures, 4).agg(
        F.countDistinct("page_id").alias("archived_pages"), F.coalesce(F.sum("raw_bytes"), F.lit(0)).cast("long").alias("uncompressed_bytes"), F.countDistinct("host_id").alias("archive_hosts"), F.countDistinct("object_id").alias("archive_objects")
    )


#: What the statistics count the distinct members of.
KINDS = ("page", "host", "object")


def members_of(captures: DataFrame) -> DataFrame:
    """kind, id and raw_bytes (of pages' rows alone, so that a capture's bytes count once) of the captures that are for archiving."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_id").cast("long").alias("id"), (F.coalesce("raw_bytes", F.lit(0)) if k == "page" else F.lit(0)).cast("long").alias("raw_bytes")) for k in KINDS])
    return eligible(captures, 4).select(F.explode(kinds).alias("x")).select("x.*").where("id IS NOT NULL")


def totals_delta(known: DataFrame, captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (kind, id) that captures bring beyond those known, and what they add to the totals: kind, members, raw_bytes.

    Deltas of batches one after another add up (merged_totals), each against the members after the one before. Rows are summed by member before they are shuffled.
    """
    by = members_of(captures).groupBy("kind", "id").agg(F.sum("raw_bytes").alias("raw_bytes"))
    rows = kept(by.join(known.select("kind", "id", F.lit(True).alias("_known")), ["kind", "id"], "left").select("kind", "id", "raw_bytes", F.col("_known").isNull().alias("is_new")), "members")
    return rows.where("is_new").select("kind", "id"), rows.groupBy("kind").agg(F.count_if("is_new").alias("members"), F.sum("raw_bytes").alias("raw_bytes"))


def merged_totals(*totals: DataFrame) -> DataFrame:
    """Totals or deltas (kind, members, raw_bytes) added up."""
    out = totals[0]
    for more in totals[1:]:
        out = out.unionByName(more)
    return out.groupBy("kind").agg(F.sum("members").alias("members"), F.sum("raw_bytes").alias("raw_bytes"))


def cut_bytes(c: Column, most: int) -> Column:
    head = F.make_valid_utf8(F.substring(c.cast("binary"), 1, most).cast("string"))
    return F.when(F.octet_length(c) <= most, c).otherwise(F.regexp_replace(head, "\uFFFD+$", ""))


def running_max(df: DataFrame, order: str, value: str, out: str, slice_rows: int = 1 << 20) -> DataFrame:
    """Adds the largest value of the rows up to this one, by a dense numeric order: within slices of it, and from slice to slice by their maxima. No task has more than a slice."""
    rows = df.withColumn("_slice", F.floor(F.col(order) / slice_rows))
    before = rows.groupBy("_slice").agg(F.max(value).alias("_m")).select("_slice", F.max("_m").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    within = F.max(value).over(Window.partitionBy("_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_within", within).join(F.broadcast(before), "_slice").withColumn(out, F.greatest("_within", "_before")).drop("_slice", "_within", "_before")


def violations(captures: DataFrame) -> DataFrame:
    """Rows that a writer would refuse, and why: the first rule broken."""
    why = (
        F.when(F.col("redirect_count") < 0, "redirect_count")
        .when(F.col("ended_ms") < F.col("started_ms"), "ended_before_started")
        .when(F.col("robots_bitfield").bitwiseAND(~ALL_MODES) != 0, "robots_bitfield")
        .when(F.octet_length("meta") > 1024, "meta_too_long")
    )
    return captures.withColumn("violation", why).where("violation IS NOT NULL")


def outcome(captures: DataFrame) -> DataFrame:
    """How a fetch is stored: 2x keeps its body, 3x without a target is an error, texts are cut to 1024 bytes (and a letter that is cut through goes)."""
    status = F.col("status_code")
    lost = status.between(30, 39) & F.col("redirected_to_page_id").isNull()
    return captures.select(
        "crawl_result_id",
        F.when(~lost, status).alias("status_code"),
        F.when(status.between(20, 29), F.col("object_id")).alias("object_id"),
        F.when(lost, F.lit("invalid redirect target")).otherwise(cut_bytes(F.col("meta"), 1024)).alias("meta"),
    )
