"""What readers are shown: archived pages with their banner and navigation, lists of links, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats, urls
from ..functions.gemtext import rewritten
from ..functions.mime import media_type

NOTE = "> Links in this page are rewritten to point to the archive for better archive viewing experience"


def banner(url: Column, ended_ms: Column, meta: Column, raw_bytes: Column, certificate: Column) -> Column:
    """The lines above an archived page: where and when it is from, and what it was."""
    return F.concat(
        F.lit("```\nArchive of "), url, F.lit(" received at "), formats.utc_timestamp(ended_ms), F.lit(".\n> mime: "), F.coalesce(meta, F.lit("application/octet-stream")),
        F.lit("\n> size: "), F.coalesce(raw_bytes, F.lit(0)).cast("string"), F.lit("\n> certificate: "), F.coalesce(certificate, F.lit("none")), F.lit(f"\n```\n\n{NOTE}\n\n"),
    )


def navigation(url: Column, param: Column, previous: Column, following: Column) -> Column:
    """Links to the page's history and to the versions beside this one, where there are any."""
    version = lambda i: urls.archive_link(url, param, F.concat(F.lit("/version/"), i.cast("string")))
    line = lambda i, text: F.when(i.isNotNull(), F.concat(F.lit("=> "), version(i), F.lit(f" {text}\n"))).otherwise("")
    return F.concat(F.lit("=> "), urls.archive_link(url, param, F.lit("/history")), F.lit(" \U0001f4dc Page history\n"), line(previous, "⬅ Previous version"), line(following, "➡ Next version"))


def archived(rows: DataFrame) -> DataFrame:
    """crawl_result_id, status, header and body of archived captures over Gemini.

    rows: crawl_result_id, url, ended_ms, status_code, meta, raw_bytes, certificate, body (text), redirect_url, previous_id, next_id. A 2x page of gemtext has banner, navigation and its
    text with links led to the archive; another has its body as it is. A 3x tells where it led, else what it said; without a status it is a 51.
    """
    p = urls.parts(rows, "url", "_u_")
    text = rewritten(rows.where("body IS NOT NULL").select("crawl_result_id", "body", "url"), "crawl_result_id", "body", "url").withColumnRenamed("body", "_text")
    p = p.join(text, "crawl_result_id", "left")
    status = F.coalesce("status_code", F.lit(51))
    gem = status.between(20, 29) & F.coalesce(media_type("meta") == "text/gemini", F.lit(False))
    page = F.concat(banner(F.col("url"), F.col("ended_ms"), F.col("meta"), F.col("raw_bytes"), F.col("certificate")), navigation(F.col("url"), F.col("_u_param"), F.col("previous_id"), F.col("next_id")), F.lit("\n---\n\n"), F.coalesce("_text", F.lit("")))
    header = F.when(gem, "text/gemini; charset=utf-8").when(status.between(20, 29), F.coalesce("meta", F.lit("application/octet-stream"))).when(status.between(30, 39), F.coalesce("redirect_url", "meta", F.lit("gemini://invalid/"))).otherwise(F.coalesce("meta", F.lit("Archived Gemini failure")))
    return p.select("crawl_result_id", status.cast("long").alias("status"), header.alias("header"), F.when(gem, page).when(status.between(20, 29), F.col("body")).alias("body"))


def link_list(title: str, rows: DataFrame, empty: str, limit: int = 1000) -> DataFrame:
    """One row: a document (gemtext) that lists url and host of rows in the order of their URLs, at most so many; or says that there are none. And json, their URLs alone."""
    top = rows.select("url", "host").orderBy("url").limit(limit)
    made = top.agg(F.array_sort(F.collect_list(F.struct("url", "host"))).alias("l"))
    lines = F.array_join(F.transform("l", lambda x: F.concat(F.lit("=> "), x["url"], F.lit(" "), x["host"], F.lit("\n"))), "")
    return made.select(F.concat(F.lit(f"# {title}\n\n"), F.when(F.size("l") == 0, F.lit(empty)).otherwise(lines)).alias("gemtext"), F.to_json(F.transform("l", lambda x: x["url"])).alias("json"))


def statistics(stats: DataFrame, units: tuple[str, ...] = formats.UNITS) -> DataFrame:
    """One row: the archive's figures (history.statistics) as a document; units: those that its size may have."""
    line = lambda name, v: F.concat(F.lit(f"{name}: "), v, F.lit("\n"))
    return stats.select(
        F.concat(
            F.lit("# Archive statistics\n\n"), line("Total archived pages", F.col("archived_pages").cast("string")), line("Uncompressed (and non-deduplicated) archive size", formats.iec_bytes(F.col("uncompressed_bytes"), units)),
            line("Unique hosts", F.col("archive_hosts").cast("string")), line("Unique objects", F.col("archive_objects").cast("string")),
        ).alias("gemtext")
    )


def status(progress: DataFrame, run: dict[str, int], snapshot: str) -> DataFrame:
    """One row: json, the state of a crawl: what the archive holds (progress: pages, queued, claimed, crawl_results, objects) and what this run has done (claimed, processed, completed, failed, blocked, workers)."""
    counts = {f"{k}_this_run": F.lit(run.get(k, 0)) for k in ("claimed", "processed", "completed", "failed", "blocked")} | {"workers_alive": F.lit(run.get("workers", 0)), "snapshot": F.lit(snapshot)}
    fields = counts | {c: F.col(c) for c in ("pages", "crawl_results", "objects")} | {"queue": F.struct("claimed", "queued")}
    return progress.select(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])).alias("json"))


def retrieved(results: DataFrame, mode: str) -> DataFrame:
    """crawl_result_id and json of retrieved captures: the result (json, as feed.result_json gives it) with the mode, and body and certificate in base64 where there are any."""
    part = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f',"{name}":"'), F.regexp_replace(F.base64(c), "[\\r\\n]", ""), F.lit('"'))).otherwise("")
    text = F.concat(F.expr("left(json, length(json) - 1)"), part("body_base64", "body"), part("certificate_der_base64", "certificate"), F.lit(f',"mode":"{mode}"}}'))
    return results.select("crawl_result_id", text.alias("json"))


def profile(samples: DataFrame, top: int = 20) -> DataFrame:
    """sql (on one line), steps, rows, total_ms, mean_ms and max_ms of the statements that took longest, and position. samples: sql, row (whether the step gave one), ms."""
    from pyspark.sql import Window

    by = samples.groupBy(formats.compact_sql(F.col("sql")).alias("sql")).agg(F.count("*").alias("steps"), F.count_if("row").alias("rows"), F.sum("ms").alias("total_ms"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms"))
    ranked = by.orderBy(F.col("total_ms").desc(), "sql").limit(top)
    return ranked.withColumn("position", F.row_number().over(Window.orderBy(F.col("total_ms").desc(), "sql")).cast("long"))
