"""Line deduplication by pairwise alignment of documents that share runs of lines.

A run is as few neighbouring lines as have ``BLOCK_WORDS`` words, from each line on or up to it. Every block that may be deleted is made of runs that both
documents have. A document is first aligned with the first (the smallest id) that has each of its runs; where lines of a run
are left after that, as the first's alignment went another way, with every earlier document of that run. So what is deleted is what an alignment with all
earlier documents deletes, and pairs grow with the lines; only runs that stay after the first alignment have a pair for each earlier document. A pair is aligned by
patience diff: lines that are unique in both and in the same order are fixed points, between which the same is done again, and equal lines beside
them join. Blocks of aligned neighbouring lines with ``BLOCK_WORDS`` words or more are deleted from the later document; the first document keeps its lines.

Lines are known by 64-bit hashes of their bytes, and a document's go into the pairs as hashes, not as text. Null ids aren't compared; null texts have no lines.
Rows of one id and text are one document, and lose the same lines; other texts of that id are documents of their own, and none of them is earlier than another.
No documents: no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

BLOCK_WORDS = 20


def _uid(key: str):
    """What tells a document from the others: its id and text."""
    return F.xxhash64(F.col(f"`{key}`"), F.col("text"))


def line_hashes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """uid, doc_id, lines (hashes) and words (of each line)."""
    slim = docs.select(_uid(key).alias("uid"), F.col(f"`{key}`").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = T.StructType([slim.schema["uid"], slim.schema["doc_id"], *T._parse_datatype_string("lines array<long>, words array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = np.asarray(batch.column(2).is_null())
            hashes, words, sizes = [], [], []
            for _, _, data, offs in C.chunks(batch.column(2)):
                breaks = np.flatnonzero(data == 10)
                ls = np.concatenate([offs[:-1], breaks + 1])
                le = np.concatenate([offs[1:], breaks])
                ls.sort(kind="stable")
                le.sort(kind="stable")  # a line ends where the next break or its text does
                s, _, _ = C.word_bounds(data, offs, C.BLANK_WORD)
                hashes.append(C.word_hashes(data, ls, le))
                words.append(np.searchsorted(s, le) - np.searchsorted(s, ls))
                n = np.diff(np.searchsorted(breaks, offs)) + 1
                sizes.append(n)
            sizes_ = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes_)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(t) if x else np.zeros(0, t))) for x, t in (([h.view(np.int64) for h in hashes], np.int64), (words, np.int32))]
            empty = [pa.array([None if n else v for n, v in zip(none, x.to_pylist(), strict=True)], x.type) if none.any() else x for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *empty], names=schema.names)

    return C.map_arrow(slim, run, schema)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions of aligned equal lines, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        here, there = Counter(a[i:j]), Counter(b[k:m])
        place = {a[x]: x for x in range(i, j) if here[a[x]] == 1}
        pairs = [(place[b[y]], y) for y in range(k, m) if there[b[y]] == 1 and b[y] in place]
        fixed = _rising(pairs)
        if not fixed:
            continue
        bounds = [(i - 1, k - 1), *fixed, (j, m)]
        out += fixed
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(bounds, bounds[1:], strict=False)]
    return sorted(out)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, in the order given, that rises in its first entry."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for n, (x, _) in enumerate(pairs):
        k = bisect_left(tops, x)
        back.append(at[k - 1] if k else -1)
        tops[k : k + 1] = [x]
        at[k : k + 1] = [n]
    out = []
    n = at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def common_blocks(a: list[int], b: list[int], words: list[int], least: int = BLOCK_WORDS) -> list[tuple[int, int]]:
    """Ranges of b's lines that are aligned with neighbouring lines of a, of so many words at least."""
    out: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []
    for x in [*patience(a, b), (-9, -9)]:
        if run and (x[0] != run[-1][0] + 1 or x[1] != run[-1][1] + 1):
            lo, hi = run[0][1], run[-1][1] + 1
            if sum(words[lo:hi]) >= least:
                out.append((lo, hi))
            run = []
        run.append(x)
    return out


def _runs(hashes: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, start and end of the least runs of a document's lines."""
    n = len(hashes)
    upto = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    end = np.searchsorted(upto, upto[:-1] + least)  # of the run from each line on
    start = np.searchsorted(upto, upto[1:] - least, "right") - 1  # of the run up to each line
    lo = np.concatenate([np.flatnonzero(end <= n), start[start >= 0]])
    hi = np.concatenate([end[end <= n], np.flatnonzero(start >= 0) + 1])
    lo, hi = np.divmod(np.unique(lo * (n + 1) + hi), n + 1)
    up, down = C._power_tables(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:n], dtype=np.uint64)])
    return C.splitmix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64)), lo, hi


def runs(lines: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """uid, doc_id, run (a hash of its lines), lo and hi of each least run of block_words words or more."""
    schema = T.StructType([lines.schema["uid"], lines.schema["doc_id"], *T._parse_datatype_string("run long, lo int, hi int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, words = (batch.column(i).flatten().to_numpy() for i in (2, 3))
            at = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())])
            found = [_runs(hashes[a:b].view(np.uint64), words[a:b], block_words) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            row = np.repeat(np.arange(batch.num_rows), [len(k) for k, _, _ in found])
            key, lo, hi = (np.concatenate(x) if found else np.zeros(0, np.uint64) for x in (list(zip(*found, strict=True)) or [[]] * 3))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(key.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=schema.names)

    return C.map_arrow(lines.select("uid", "doc_id", "lines", "words"), run, schema)


def _aligned(pairs: DataFrame, lines: DataFrame, block_words: int) -> DataFrame:
    """uid and blocks of the pairs (uid and first, the uid of an earlier document) that have any."""
    later = lines.select("uid", F.col("lines").alias("b"), "words")
    earlier = lines.select(F.col("uid").alias("first"), F.col("lines").alias("a"))
    rows = pairs.join(later, "uid").join(earlier, "first").select("uid", "a", "b", "words")
    schema = T.StructType([lines.schema["uid"], *T._parse_datatype_string("blocks array<struct<lo:int,hi:int>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [common_blocks(a, b, w, block_words) for a, b, w in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            keep = pa.array([bool(x) for x in out])
            blocks = pa.array([[{"lo": lo, "hi": hi} for lo, hi in x] for x in out if x], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), blocks], names=schema.names)

    return C.map_arrow(rows, run, schema)


def _gathered(found: DataFrame) -> DataFrame:
    return found.groupBy("uid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("blocks")))).alias("blocks"))


def deletions(docs: DataFrame, key: str = "doc_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """uid and blocks (ranges lo, hi of lines to delete) of the documents that lose any."""
    lines = C.staged(line_hashes(docs, key).where("doc_id IS NOT NULL AND lines IS NOT NULL").dropDuplicates(["uid"]), "lines")
    each = runs(lines, block_words)
    first = each.groupBy("run").agg(F.min(F.struct("doc_id", "uid")).alias("f"), F.max("doc_id").alias("last")).where("f.doc_id < last").select("run", F.col("f.doc_id").alias("before"), F.col("f.uid").alias("first"))
    shared = C.staged(each.join(first, "run"), "runs")
    late = shared.where("before < doc_id")
    pairs = C.staged(late.select("uid", "first").distinct(), "pairs")
    found = C.staged(_aligned(pairs, lines, block_words), "aligned")
    inside = lambda i: F.exists("blocks", lambda b: (i >= b["lo"]) & (i < b["hi"]))
    left = late.join(_gathered(found), "uid", "left").where(F.col("blocks").isNull() | F.exists(F.sequence("lo", F.col("hi") - 1), lambda i: ~inside(i))).select("uid", "doc_id", "run").distinct()
    others = left.join(shared.select("run", F.col("uid").alias("first"), F.col("doc_id").alias("before")).distinct(), "run").where("before < doc_id").select("uid", "first").distinct()
    more = C.staged(others.join(pairs, ["uid", "first"], "left_anti"), "more")
    return _gathered(found.union(_aligned(more, lines, block_words)))


def without_repeated_blocks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents with such blocks deleted, and n_lines, n_deleted and words_deleted; other columns as they were."""
    gone = C.staged(deletions(docs, key), "blocks").select(F.col("uid").alias("_gone"), "blocks")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.when(F.col(f"`{key}`").isNotNull(), _uid(key)).alias("_uid"), F.split("text", "\n").alias("_lines"))
    inside = lambda i: F.exists("blocks", lambda b: (i >= b["lo"]) & (i < b["hi"]))
    n_words = lambda lines: F.regexp_count(F.array_join(lines, "\n"), F.lit("[^ \\t-\\r]+")).cast("long")
    left = F.when(F.col("blocks").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda x, i: ~inside(i)))
    out = rows.join(gone.hint("merge"), F.col("_uid") == F.col("_gone"), "left").withColumn("_left", left)
    row = {c: F.col(f"_row.`{c}`") for c in docs.columns} | {
        "text": F.array_join("_left", "\n"),
        "n_lines": F.coalesce(F.size("_lines"), F.lit(0)).cast("long"),
        "n_deleted": F.coalesce(F.size("_lines") - F.size("_left"), F.lit(0)).cast("long"),
        "words_deleted": F.when(F.col("blocks").isNull(), F.lit(0).cast("long")).otherwise(n_words(F.col("_lines")) - n_words(F.col("_left"))),
    }
    return out.select(*[v.alias(k) for k, v in row.items()])


def op9_line_alignment(spark, sf_dir: str) -> DataFrame:
    out = without_repeated_blocks(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", "words_deleted", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
