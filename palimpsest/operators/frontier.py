"""The crawl frontier: queues, schedules, claims and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import REASONS
from ..session import kept

MOST_FAILURES = 32767
DAY_S = 24 * 3600
#: Seconds to wait after a first failure.
BACKOFF = {"timeout": 300, "network": 900, "badresponse": 3600, "other": 600}


def merge(requests: DataFrame) -> DataFrame:
    """One queue row for each page: reasons joined, the earliest time, claimed only if all are."""
    return requests.groupBy("page_id").agg(F.min("host_id").alias("host_id"), F.bit_or("reason").cast("long").alias("reason"), F.min("ready_at_ms").alias("ready_at_ms"), F.min("state_code").alias("state_code"))


def merge_into(queue: DataFrame, requests: DataFrame) -> DataFrame:
    """The queue with requests: reasons join; a ready row takes the earlier time, a claimed one keeps its own."""
    new = requests.groupBy("page_id").agg(F.min("host_id").alias("_host"), F.bit_or("reason").cast("long").alias("_reason"), F.min("ready_at_ms").alias("_ready"))
    both = queue.join(new, "page_id", "full")
    ready = F.when(F.col("state_code") == 1, F.col("ready_at_ms")).otherwise(F.least("ready_at_ms", "_ready"))
    reason = F.coalesce("reason", F.lit(0)).bitwiseOR(F.coalesce("_reason", F.lit(0))).cast("long")
    return both.select("page_id", F.coalesce("host_id", "_host").alias("host_id"), reason.alias("reason"), ready.alias("ready_at_ms"), F.coalesce("state_code", F.lit(0)).cast("long").alias("state_code"))


def host_next(queue: DataFrame, hosts: DataFrame) -> DataFrame:
    """Each host's earliest ready page; null without any."""
    return hosts.join(queue.where("state_code = 0").groupBy("host_id").agg(F.min("ready_at_ms").alias("next_queued_ms")), "host_id", "left")


def ready_after(*times: Column) -> Column:
    """When a host may be asked: the latest of its times, a missing one counting as 0."""
    return F.greatest(*[F.coalesce(t, F.lit(0)) for t in times])


def claim(queue: DataFrame, hosts: DataFrame, now: int, busy: DataFrame) -> DataFrame:
    """The next claim of each free host, hosts ranked by when they may be asked: its earliest ready page.

    hosts: host_id, authority, status_code, polite_after_ms, retry_after_ms; busy: authority, of hosts that are being asked.
    """
    free = hosts.join(busy, "authority", "left_anti").where("status_code = 0").withColumn("ready_after_ms", ready_after(F.col("polite_after_ms"), F.col("retry_after_ms")))
    due = queue.where((F.col("state_code") == 0) & (F.col("ready_at_ms") <= now))
    first = due.groupBy("host_id").agg(F.min(F.struct("ready_at_ms", "page_id")).alias("p"))
    rows = first.join(free.where(F.col("ready_after_ms") <= now), "host_id")
    return rows.select(F.row_number().over(Window.orderBy("ready_after_ms", "host_id")).cast("long").alias("turn"), "host_id", "authority", "p.page_id", "p.ready_at_ms")


def fallback(queue: DataFrame, hosts: DataFrame, now: int, limit: int = 1) -> DataFrame:
    """Pages by when their hosts may be asked, then by their own time, from the whole queue."""
    rows = queue.where((F.col("state_code") == 0) & (F.col("ready_at_ms") <= now)).join(hosts.where("status_code = 0"), "host_id")
    return rows.withColumn("ready_after_ms", ready_after(F.col("polite_after_ms"), F.col("retry_after_ms"))).where(F.col("ready_after_ms") <= now).orderBy("ready_after_ms", "ready_at_ms", "page_id").limit(limit).select("page_id", "host_id", "ready_after_ms", "ready_at_ms")


def next_ready(queue: DataFrame, hosts: DataFrame) -> DataFrame:
    rows = queue.where("state_code = 0").join(hosts.where("status_code = 0"), "host_id")
    return rows.agg(F.min(F.greatest("ready_at_ms", ready_after(F.col("polite_after_ms"), F.col("retry_after_ms")))).alias("next_ready_ms"))


def schedules(watched: DataFrame, automatic: DataFrame) -> DataFrame:
    """Both kinds of schedule: page_id, next_enqueue_ms, automatic (0, 1). A page may be in both."""
    return watched.select("page_id", "next_enqueue_ms", F.lit(0).cast("long").alias("automatic")).unionByName(automatic.select("page_id", "next_enqueue_ms", F.lit(1).cast("long").alias("automatic")))


def due(schedule: DataFrame, queue: DataFrame, now: int, limit: int = 256) -> DataFrame:
    """Schedules that are due, with what the queue already has for the page."""
    rows = schedule.where(F.col("next_enqueue_ms") <= now).orderBy("next_enqueue_ms", "page_id", "automatic").limit(limit)
    return rows.join(queue.select("page_id", F.col("reason").alias("queued_reason")), "page_id", "left")


def decide(now: int, interval: int, jitter: int) -> int:
    """When a page is due again."""
    if interval <= 0:
        raise ValueError("interval must be positive")
    out = now + interval + jitter
    if not now < out < 1 << 63:
        raise ValueError("schedule out of range")
    return out


def apply_decision(schedule: DataFrame, decisions: DataFrame) -> DataFrame:
    """Compare and set: decisions (page_id, automatic, expected_ms, next_ms) whose expected time is still the schedule's take effect; applied tells."""
    rows = schedule.join(decisions, ["page_id", "automatic"], "left")
    hit = F.coalesce(F.col("expected_ms") == F.col("next_enqueue_ms"), F.lit(False))
    return rows.select("page_id", "automatic", F.when(hit, F.col("next_ms")).otherwise(F.col("next_enqueue_ms")).alias("next_enqueue_ms"), hit.alias("applied"))


def failures(attempts: DataFrame) -> DataFrame:
    """Of each host that failed since its last success: consecutive failures, at most 32767, and when both last were. attempts: host_id, attempt (rising), at_ms, failed.

    Sums by host before any shuffle; what is joined back has a row for each host.
    """
    last = attempts.groupBy("host_id").agg(F.max(F.when(~F.col("failed"), F.col("attempt"))).alias("_ok"), F.max(F.when(~F.col("failed"), F.col("at_ms"))).alias("last_success_ms"))
    since = attempts.where("failed").join(last, "host_id").where(F.col("_ok").isNull() | (F.col("attempt") > F.col("_ok")))
    return since.groupBy("host_id").agg(F.least(F.count("*"), F.lit(MOST_FAILURES)).cast("long").alias("consecutive_failures"), F.max("at_ms").alias("last_failure_ms"), F.max("last_success_ms").alias("last_success_ms"))


def _of_claims(queue: DataFrame, claims: DataFrame) -> tuple[DataFrame, Column]:
    """The queue with the columns of claims (page_id and others), and whether a row is claimed and among them."""
    rows = queue.join(claims.withColumn("_asked", F.lit(True)), "page_id", "left")
    return rows, (F.col("state_code") == 1) & F.coalesce("_asked", F.lit(False))


def release(queue: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims (page_id, again_ms) given back, ready at a time; what isn't claimed stays as it is."""
    rows, mine = _of_claims(queue, claims)
    return rows.withColumns({"ready_at_ms": F.when(mine, F.col("again_ms")).otherwise(F.col("ready_at_ms")), "state_code": F.when(mine, 0).otherwise(F.col("state_code")).cast("long")}).select(queue.columns)


def discard(queue: DataFrame, claims: DataFrame) -> DataFrame:
    """The queue without claims (page_id); a row that isn't claimed stays."""
    rows, mine = _of_claims(queue, claims)
    return rows.where(~mine).select(queue.columns)


def recover(queue: DataFrame) -> DataFrame:
    """After a restart nothing is claimed; the rest of a row stays."""
    return queue.withColumn("state_code", F.when(F.col("state_code") == 1, 0).otherwise(F.col("state_code")).cast("long"))


def complete(queue: DataFrame, done: DataFrame) -> DataFrame:
    """done (page_id, retry_ms): a claim without a time to retry is done and goes, else it is ready then, for the reason retry too. A row that isn't claimed any more is an error."""
    rows, mine = _of_claims(queue, done)
    lost = F.coalesce("_asked", F.lit(False)) & (F.col("state_code") != 1)
    rows = rows.withColumn("reason", F.when(lost, F.raise_error(F.concat(F.lit("lost claim of page "), F.col("page_id").cast("string"))).cast("long")).when(mine, F.col("reason").bitwiseOR(REASONS["retry"])).otherwise(F.col("reason")).cast("long"))
    rows = rows.where(~mine | F.col("retry_ms").isNotNull())
    return rows.withColumns({"ready_at_ms": F.when(mine, F.col("retry_ms")).otherwise(F.col("ready_at_ms")), "state_code": F.when(mine, 0).otherwise(F.col("state_code")).cast("long")}).select(queue.columns)


def seed(queue: DataFrame, seeds: DataFrame, latest: DataFrame) -> DataFrame:
    """The queue with seeds (page_id, host_id, ready_at_ms) of pages that were never fetched, as submitted. latest: page_id of those that were."""
    new = seeds.join(latest.select("page_id"), "page_id", "left_anti")
    return merge_into(queue, new.withColumn("reason", F.lit(REASONS["submitted"]).cast("long")))


def watch(watched: DataFrame, asked: DataFrame) -> DataFrame:
    """Watched pages (page_id, added_at_ms, next_enqueue_ms) with those asked for: a new time for a page that is watched, which keeps when it was added."""
    both = watched.select("page_id", F.col("added_at_ms").alias("_added"), F.col("next_enqueue_ms").alias("_next")).join(asked, "page_id", "full")
    return both.select("page_id", F.coalesce("_added", "added_at_ms").alias("added_at_ms"), F.coalesce("next_enqueue_ms", "_next").alias("next_enqueue_ms"))


def unwatch(watched: DataFrame, pages: DataFrame) -> DataFrame:
    return watched.join(pages.select("page_id"), "page_id", "left_anti")


def unqueued(targets: DataFrame, captures: DataFrame, queue: DataFrame) -> DataFrame:
    """page_id of targets that were never fetched and aren't queued."""
    return targets.select("page_id").distinct().join(captures, "page_id", "left_anti").join(queue, "page_id", "left_anti")


def fresh_robots(robots: DataFrame, now: int, version: int = 1) -> DataFrame:
    """Stored robots rules of this parser that hold beyond a time."""
    return robots.where((F.col("parser_version") == version) & (F.col("expires_ms") > now))


def backoff(kind: Column, attempts: Column) -> Column:
    """The longest wait in seconds before a retry: doubling to a day; a name that can't be resolved waits a day. The wait is drawn between half of it and all."""
    base = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in BACKOFF.items()], F.lit(BACKOFF["other"]))
    doubled = base * F.pow(F.lit(2), F.greatest(F.lit(0), F.least(F.lit(7), attempts - 1)))
    return F.when(kind == "dns", F.lit(DAY_S)).otherwise(F.least(doubled, F.lit(DAY_S))).cast("long")


def discover(links: DataFrame, known: DataFrame, latest: DataFrame) -> DataFrame:
    """Distinct linked pages that were never fetched: page_id and whether it is new to the archive."""
    targets = links.select("page_id").distinct().join(latest, "page_id", "left_anti")
    return targets.join(known.select("page_id", F.lit(True).alias("_known")), "page_id", "left").select("page_id", F.col("_known").isNull().alias("is_new"))


def intern(existing: DataFrame, incoming: DataFrame, natural: str, surrogate: str) -> DataFrame:
    """existing with the natural keys of incoming that it lacks, numbered after its own by their order."""
    new = incoming.select(natural).distinct().join(existing, natural, "left_anti")
    top = existing.agg(F.coalesce(F.max(surrogate), F.lit(0)).alias("_top"))
    return existing.select(surrogate, natural).unionByName(numbered(new, natural, surrogate).crossJoin(F.broadcast(top)).select((F.col(surrogate) + F.col("_top")).alias(surrogate), natural))


def numbered(df: DataFrame, order: str, out: str) -> DataFrame:
    """Adds 1, 2, .. by an order of distinct values: sorted by ranges, numbered within each range, and the ranges' counts summed up. No task has all rows."""
    rows = kept(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_n", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_n", 33)
    rows = rows.withColumn("_part", part)
    before = rows.groupBy("_part").agg(F.count("*").alias("_c")).select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_n").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_n", "_before")


def upsert_registry(known: DataFrame, judged: DataFrame) -> DataFrame:
    """known feeds (page_id, feed_type, first_recognized_ms, last_recognized_ms) after judgements (page_id, feed_type, committed_ms, status_code): no type or a 5x takes a page out."""
    both = known.select("page_id", F.col("feed_type").alias("_type"), F.col("first_recognized_ms").alias("_first"), F.col("last_recognized_ms").alias("_last")).join(judged.withColumn("_judged", F.lit(True)), "page_id", "full")
    stays = F.col("_judged").isNull() | (F.col("feed_type").isNotNull() & ~F.coalesce(F.col("status_code").between(50, 59), F.lit(False)))
    return both.where(stays).select("page_id", F.coalesce("feed_type", "_type").alias("feed_type"), F.coalesce("_first", "committed_ms").alias("first_recognized_ms"), F.coalesce("committed_ms", "_last").alias("last_recognized_ms"))


def registry(evaluations: DataFrame) -> DataFrame:
    """Pages that are feeds by their last evaluation: page_id, feed_type, first and last recognised. A type of null or a status of 5x takes a page out.

    First is since it was last taken out. Sums by page before any shuffle, and what is joined back has a row for each page that was ever taken out, so a page of many evaluations is no burden.
    """
    gone = F.col("feed_type").isNull() | F.coalesce(F.col("status_code").between(50, 59), F.lit(False))
    out = evaluations.where(gone).groupBy("page_id").agg(F.max("crawl_result_id").alias("_gone"))
    kept = evaluations.where(~gone).join(out, "page_id", "left").where(F.col("_gone").isNull() | (F.col("crawl_result_id") > F.col("_gone")))
    return kept.groupBy("page_id").agg(F.max_by("feed_type", "crawl_result_id").alias("feed_type"), F.min("committed_ms").alias("first_recognized_ms"), F.max("committed_ms").alias("last_recognized_ms"))
