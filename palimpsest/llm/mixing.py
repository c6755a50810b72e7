"""Mixing sources to target weights by weighted fair queueing.

Sources share the words of all documents by weight. A target stops at ``most`` times its source's words, and the excess
is shared again by weight until none is above. Each source deals its documents in a shuffled order (by a hash of the
key), as often as ``most`` times over. A copy's virtual finish time is the source's words up to its end over the target; all
copies are sorted by it, and those within the total budget are taken.

No task holds a source: documents lie in slices of equal hash ranges, the slices' sums give each its base, and the
running sums are made within slices. The queue is range-sorted by finish time; its ranges' sums tell the one in which the budget ends, and that one alone is summed row by row.

Null texts have no words; a document without words is never taken. A null source is a source of its own, the last.
Repeated rows are documents of their own; rows of one key are in a row in the shuffled order, the shorter first. No documents: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Documents for each slice, and the most slices.
SLICE_ROWS, MOST_SLICES = 4_000, 1 << 20
#: Rows of a range of the queue, at most, where there are more than the session's partitions hold.
RANGE_ROWS = 1 << 18


def n_blank_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """source, source_size, target. sizes: a row for each source (source, source_size); the weights 1, 2, 3 repeat in the sources' order.

    The level at which sources are filled is found in one pass: in ascending order of cap over weight, a source is capped
    when what the uncapped would get for each unit of weight, with it among them, reaches its cap.
    """
    ranked = sizes.withColumn("weight", (1 + F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(3))).cast("double"))
    total = Window.partitionBy()
    w = Window.orderBy(F.expr("cap / weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumns({"all_words": F.sum("source_size").over(total).cast("double"), "all_weight": F.sum("weight").over(total)})
        .withColumns({"before": F.coalesce(F.sum("cap").over(w), F.lit(0.0)), "weight_before": F.coalesce(F.sum("weight").over(w), F.lit(0.0))})
        .withColumn("capped", F.expr("cap * (all_weight - weight_before) <= weight * (all_words - before)"))
        .withColumns({"caps": F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(total), F.lit(0.0)), "capped_weight": F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(total), F.lit(0.0))})
    )
    return level.select("source", "source_size", F.expr("CASE WHEN capped THEN cap ELSE weight * (all_words - caps) / (all_weight - capped_weight) END").alias("target"))


def running_sum(df: DataFrame, group: list[str], slice_col: str, order: list, value: str, out: str) -> DataFrame:
    """Adds the sum of value over the rows before and at this one, within group: slices come in order, and rows in a slice by order."""
    within = Window.partitionBy(*group, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy(*group, slice_col).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*[F.col(g).alias(f"_{g}") for g in group], F.col(slice_col).alias("_slice"), F.coalesce(F.sum("_sum").over(before), F.lit(0).cast("long")).alias("_base"))
    on = F.col(slice_col) == F.col("_slice")
    for g in group:
        on &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    return df.withColumn("_within", F.sum(value).over(within)).join(bases, on).withColumn(out, F.col("_base") + F.col("_within")).drop("_base", "_within", "_slice", *[f"_{g}" for g in group])


def mix(docs: DataFrame, most: int = 3, seed: str = "", size: Column | None = None, key: str = "doc_id", more: list[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken of each document (row), and more of its columns. size: long; the words of the text by default."""
    rows = C.staged(docs.select(F.col(key).alias("doc_id"), F.col("source"), (n_blank_words(F.col("text")) if size is None else size).alias("size"), *more), "sizes")
    by_source = C.staged(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), most), "targets")
    total = by_source.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    slices = max(1, min(MOST_SLICES, rows.count() // SLICE_ROWS))
    keyed = rows.withColumn("shuffled", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))).withColumn(
        "slice", F.floor(F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("long") * slices / F.lit(1 << 32)).cast("int")
    )
    dealt = running_sum(keyed, ["source"], "slice", [F.col("shuffled"), F.col("doc_id"), F.col("size")], "size", "upto")
    dealt = dealt.alias("d").join(by_source.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.source_size", "t.target").drop("slice")
    dealt = C.staged(dealt, "dealt")
    finish = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.when(F.col("target") > 0, (k * F.col("source_size") + F.col("upto")) / F.col("target")))
    queue = dealt.where("size > 0").select("size", F.explode(finish).alias("finish"))
    # the queue is sorted by ranges of finish times; ranges that end within the budget are taken whole, and the one where it ends up to there
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), most * rows.count() // RANGE_ROWS)
    ranges = queue.repartitionByRange(parts, "finish").sortWithinPartitions("finish").withColumn("range", F.spark_partition_id())
    ranges = C.staged(ranges, "queue")
    ends = ranges.groupBy("range").agg(F.sum("size").alias("words"), F.min("finish").alias("first"))
    ends = ends.withColumn("upto", F.sum("words").over(Window.orderBy("first"))).where(F.col("upto") > total).orderBy("first").select("range", F.col("upto") - F.col("words")).first()
    fits = None
    if ends:
        last = ranges.where(F.col("range") == ends[0]).withColumn("_upto", F.sum("size").over(Window.orderBy("finish"))).where(F.col("_upto") + ends[1] <= total)
        before = ranges.where(F.col("range") != ends[0]).join(ranges.where(F.col("range") == ends[0]).agg(F.min("finish").alias("_first")), F.col("finish") < F.col("_first"))
        fits = last.agg(F.max("finish").alias("m")).first()["m"]
        if fits is None:  # the budget ends before this range's first copy
            fits = before.agg(F.max("finish").alias("m")).first()["m"]
            fits = float("-inf") if fits is None else fits
    C.drop_staged(ranges)
    copies = F.size(F.filter(finish, lambda t: t <= F.lit(fits) if fits is not None else t.isNotNull()))
    return dealt.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0)).select(
        *more, "doc_id", "source", "shuffled", "upto", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def mixed(docs: DataFrame, most: int = 3, seed: str = "", key: str = "doc_id") -> DataFrame:
    """The documents as the mix takes them: a row for each copy, all columns kept, range-sorted by virtual finish time. Each row is taken by itself, whatever its key."""
    rows = C.staged(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{key}`").alias("_key"), "source", "text").withColumn("_rid", F.monotonically_increasing_id()), "rows")
    plan = mix(rows.select("_key", "source", n_blank_words(F.col("text")).alias("_size"), "_rid"), most, seed, F.col("_size"), "_key", ["_rid"])
    taken = plan.where("copies > 0").select("_rid", "copies", (F.col("upto") / F.col("target")).alias("_first"), (F.col("source_size") / F.col("target")).alias("_turn"))
    out = rows.select("_row", "_rid").join(taken.hint("merge"), "_rid").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return out.withColumn("_finish", F.col("_first") + F.col("_copy") * F.col("_turn")).select("_row", "_finish").repartitionByRange("_finish").sortWithinPartitions("_finish").select("_row.*")


def op4_fair_queue_mix(spark, sf_dir: str) -> DataFrame:
    return mix(C.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffled
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS DOUBLE) AS cap,
    CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS all_words, sum(weight) OVER () AS all_weight,
    coalesce(sum(cap) OVER w, 0) AS before, coalesce(sum(weight) OVER w, 0) AS weight_before
  FROM s WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT *, cap * (all_weight - weight_before) <= weight * (all_words - before) AS capped FROM f
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE weight * (all_words - coalesce(sum(cap) FILTER (capped) OVER (), 0)) / (all_weight - coalesce(sum(weight) FILTER (capped) OVER (), 0)) END AS target FROM g
), q AS (
  SELECT d.*, source_size, target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY shuffled, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, (k * source_size + upto) / target AS finish FROM q, range(3) r(k) WHERE size > 0
), u AS (
  SELECT doc_id, source, upto, sum(size) OVER (ORDER BY finish) AS used FROM c
), taken AS (
  SELECT doc_id, source, upto, count(*) AS copies FROM u WHERE used <= (SELECT sum(size) FROM d) GROUP BY ALL
)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(copies, 0) * q.size AS BIGINT) AS taken
FROM q LEFT JOIN taken ON q.doc_id = taken.doc_id AND q.source IS NOT DISTINCT FROM taken.source AND q.upto = taken.upto
"""
