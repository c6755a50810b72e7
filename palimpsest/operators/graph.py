"""Redirect chains at a fixed watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_HOPS, MOST_HOPS
from ..session import kept
from .history import as_of


def as_of_join(left: DataFrame, captures: DataFrame, use: int, at: int | None, on: str = "redirected_to_page_id") -> DataFrame:
    """left with target_id, target_status and target_next: what its target's newest visible capture was at a time."""
    top = as_of(captures, use, at).select(F.col("page_id").alias(on), F.col("crawl_result_id").alias("target_id"), F.col("status_code").alias("target_status"), F.col("redirected_to_page_id").alias("target_next"))
    return left.join(top, on, "left")


def chains(captures: DataFrame, roots: DataFrame, use: int, at: int, hops: int = DEFAULT_HOPS) -> DataFrame:
    """root, depth, page_id, crawl_result_id, status_code, next_page: from each root capture, target by target, while they redirect (30, 31).

    Depth 0 is the target's capture. Cycles run to the hop limit. roots: root (a capture's id) and page_id (its target). Walks are made for each page that redirects, by doubling: what lies 1, 2, 4, 8
    hops ahead is joined with itself, so 16 hops take four joins; a walk that has ended isn't joined again. The as-of table and each doubling are written.
    """
    hops = max(1, min(MOST_HOPS, hops))
    top = kept(as_of(captures, use, at).select("page_id", "crawl_result_id", "status_code", F.col("redirected_to_page_id").alias("next_page")), "asof")
    nodes = top.select(F.col("page_id").alias("_at"), F.struct("page_id", "crawl_result_id", "status_code", "next_page").alias("_node"), (F.col("status_code").isin(30, 31) & F.col("next_page").isNotNull()).alias("_moves"))
    ahead = nodes.select(F.col("_at").alias("_go"), F.col("_node").alias("_next"), F.col("_moves").alias("_on"))
    first = nodes.where("_moves").withColumn("_go", F.col("_node.next_page")).join(ahead, "_go", "left")
    # a walk ends with the page that doesn't redirect, or where a target has no capture
    walk = kept(first.select("_at", F.when(F.col("_on") | F.col("_next").isNull(), F.array("_node")).otherwise(F.array("_node", "_next")).alias("_path"), F.when(F.col("_on"), F.col("_go")).alias("_go")), "walk")
    reach = 1
    while reach < hops:
        walk = doubled(walk)
        reach *= 2
        walk = kept(walk, "walk") if reach < hops else walk
    starts = roots.select(F.col("page_id").alias("_at")).distinct().join(nodes, "_at").join(walk.drop("_go"), "_at", "left")
    paths = starts.select(F.col("_at").alias("_start"), F.slice(F.coalesce("_path", F.array("_node")), 1, hops).alias("_path"))
    out = roots.select("root", F.col("page_id").alias("_start")).join(paths, "_start")
    return out.select("root", F.posexplode("_path").alias("depth", "_n")).select("root", F.col("depth").cast("long").alias("depth"), "_n.*")


def doubled(walk: DataFrame) -> DataFrame:
    """Walks (_at, _path, and _go: where they go on, or null) twice as long: each with the walk from where it goes on."""
    more = walk.select(F.col("_at").alias("_go"), F.col("_path").alias("_rest"), F.col("_go").alias("_then"))
    on = walk.where("_go IS NOT NULL").join(more, "_go").select("_at", F.concat("_path", "_rest").alias("_path"), F.col("_then").alias("_go"))
    return walk.where("_go IS NULL").unionByName(on)


def verdicts(roots: DataFrame, walk: DataFrame, hops: int = DEFAULT_HOPS) -> DataFrame:
    """root, resolution (complete, cycle, unresolved_target, depth_limit), verdict, n_hops and final_page of each root capture.

    roots: root, origin (its page), page_id (its target), status_code (30 or 31). Step by step: a target seen before is a cycle, then one
    without a capture is unresolved, then one that doesn't redirect completes the chain.
    """
    ends = F.struct
    steps = walk.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("depth", "page_id", "status_code", "next_page"))).alias("steps"))  # at most the hop limit each
    none = F.lit(None)
    start = ends(
        F.array("origin").alias("seen"), F.col("page_id").alias("target"), (F.col("status_code") == 30).alias("temporary"), none.cast("string").alias("resolution"), none.cast("long").alias("final"), F.lit(1).cast("long").alias("n")
    )

    def step(acc, i):
        nxt = F.get("steps", i)
        cycle, missing = F.array_contains(acc["seen"], acc["target"]), nxt.isNull()
        onward = nxt["status_code"].isin(30, 31) & nxt["next_page"].isNotNull()
        found = F.when(cycle, "cycle").when(missing, "unresolved_target").when(~onward, "complete")
        final = F.when(cycle | missing, acc["target"]).when(~onward, nxt["page_id"])
        moved = ends(
            F.array_append(acc["seen"], acc["target"]).alias("seen"),
            F.when(found.isNull(), nxt["next_page"]).otherwise(acc["target"]).alias("target"),
            (acc["temporary"] | (found.isNull() & (nxt["status_code"] == 30))).alias("temporary"),
            found.alias("resolution"),
            final.alias("final"),
            (acc["n"] + F.when(found.isNull() | (found == "complete"), 1).otherwise(0)).alias("n"),
        )
        return F.when(acc["resolution"].isNotNull(), acc).otherwise(moved)

    done = roots.join(steps, "root", "left").withColumn("end", F.aggregate(F.sequence(F.lit(0), F.lit(hops - 1)), start, step))
    out = F.coalesce("end.resolution", F.lit("depth_limit"))
    return done.select(
        "root",
        out.alias("resolution"),
        F.when(out != "complete", "unknown").when(F.col("end.temporary"), "temporary").otherwise("permanent").alias("verdict"),
        F.col("end.n").alias("n_hops"),
        F.coalesce("end.final", "end.target").alias("final_page"),
    )
