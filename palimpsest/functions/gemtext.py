"""Gemtext: lines, links, feeds by dated links, and links rewritten to the archive's routes."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import urls
from .mime import media_type

LINK = "^=>[ \\t]*([^ \\t]+)[ \\t]*(.*)$"
ATOM = "{http://www.w3.org/2005/Atom}feed"


def lines(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, position, line, kind (link, fence, preformatted, text), target and label of each line of a body."""
    rows = df.select(key, F.posexplode(F.split(F.col(body), "\n")).alias("position", "line"))
    fence = F.col("line").startswith("```")
    w = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum(F.when(fence, 1).otherwise(0)).over(w), F.lit(0)) % 2 == 1)
    kind = F.when(fence, "fence").when(F.col("_in"), "preformatted").when(F.col("line").rlike(LINK), "link").otherwise("text")
    link = F.col("kind") == "link"
    rows = rows.withColumn("kind", kind).withColumns({"target": F.when(link, F.regexp_extract("line", LINK, 1)), "label": F.when(link, F.regexp_extract("line", LINK, 2))})
    return rows.select(key, F.col("position").cast("long").alias("position"), "line", "kind", "target", "label")


def outlinks(df: DataFrame, key: str, body: str, url: str) -> DataFrame:
    """key, position and resolved URL of each distinct link of a body, the first of equal ones."""
    links = lines(df, key, body).where("kind = 'link'").join(df.select(key, F.col(url).alias("_base")), key)
    return urls.resolve(links, "_base", "target").where("resolved IS NOT NULL").groupBy(key, "resolved").agg(F.min("position").alias("position"))


def longest_runs(df: DataFrame, key: str, order: str, flag: Column) -> DataFrame:
    """key and the longest run of consecutive rows with a flag."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_island", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w))
    return rows.groupBy(key, "_island").agg(F.sum(F.when(F.col("_f"), 1).otherwise(0)).alias("n")).groupBy(key).agg(F.max("n").cast("long").alias("longest_run"))


def subscribed(df: DataFrame, key: str, body: str, url: str) -> DataFrame:
    """key and is_feed: three consecutive lines at least are links to the same host with a date for a label."""
    rows = lines(df, key, body).join(df.select(key, F.col(url).alias("_base")), key)
    rows = urls.parts(urls.parts(urls.resolve(rows, "_base", "target"), "resolved", "r_"), "_base", "b_")
    dated = (F.col("kind") == "link") & F.col("label").rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}") & (F.col("r_host") == F.col("b_host"))
    return longest_runs(rows, key, "position", dated).select(key, (F.col("longest_run") >= 3).alias("is_feed"))


@F.pandas_udf(BooleanType())
def is_atom(body: pd.Series) -> pd.Series:
    """Whether a body is well-formed XML with an Atom feed as its root."""

    def one(b) -> bool:
        try:
            return b is not None and ET.fromstring(b).tag == ATOM
        except ET.ParseError:
            return False

    return body.map(one)


def feed_signs(meta: str | Column, path: Column, gemsub: Column, atom: Column) -> dict[str, Column]:
    """By which signs a body is a feed, the strongest first."""
    kind = F.coalesce(media_type(meta), F.lit(""))
    return {"twtxt": path.endswith("/twtxt.txt") & kind.isin("text/plain", "text/markdown", "text/x-rst"), "rss": kind == "application/rss+xml", "atom": atom, "gemsub": gemsub}


def first_sign(signs: dict[str, Column]) -> Column:
    out = None
    for name, sign in signs.items():
        out = F.when(sign, name) if out is None else out.when(sign, name)
    return out


def feed_type(meta: Column, path: Column, gemsub: Column, atom: Column) -> Column:
    """twtxt before rss before atom before gemsub; null for none."""
    return first_sign(feed_signs(meta, path, gemsub, atom))


def rewritten(df: DataFrame, key: str, body: str, url: str) -> DataFrame:
    """key and body with resolvable links led to the archive; labels, blanks and preformatted lines stay."""
    rows = lines(df, key, body).join(df.select(key, F.col(url).alias("_base")), key)
    rows = urls.parts(urls.resolve(rows, "_base", "target"), "resolved", "r_")
    link = urls.archive_link(F.col("resolved"), F.col("r_param"))
    start = F.regexp_extract("line", "^(=>[ \\t]*)", 1)
    line = F.when(F.col("resolved").isNotNull(), F.concat(start, link, F.substr("line", F.length(start) + F.length("target") + 1))).otherwise(F.col("line"))
    made = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("l"))
    return made.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias(body))
