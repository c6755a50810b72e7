"""Hard negatives by a pivot table.

A vector x gets one more component, sqrt(M - |x|^2), M the largest squared norm, and an anchor q a zero: then |q' - x'|^2 = |q|^2 + M - 2 qx, so a larger inner product is a smaller
Euclidean distance. Each row stores its distances to a few pivots. By the triangle inequality those and the anchor's own bracket the distance, and with it the score;
rows whose bracket can't reach what an anchor still asks for are passed over, and the rest are checked exactly, in whole numbers.

Anchors go in batches of ``BATCH``, each broadcast (a few MB), and all rows are read in blocks against them: once for the positives, once for the negatives. A task keeps the best few rows
of each anchor (and positive), and only those are shuffled, so neither equal vectors nor a frequent label make a large group.

Rows without an id or label, or whose vector is null or has a null or non-finite component, take no part. A shorter vector counts as if it ended in zeros. Rows of an anchor's own id aren't
its positives or negatives; rows that repeat an id count each on its own, and a repeated anchor is an anchor each time. Ties go to the smaller id. A positive of a negative score
has no negatives, as no score is both at least 80 and at most 100 percent of it. No rows or no anchors: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.frontier import numbered
from ..session import new_place
from . import common as C
from . import vectors

#: Anchors that are broadcast at a time.
BATCH = 1 << 14
#: Rows, and anchors, of a block of scores.
ROWS, ANCHORS = 8192, 128
#: Pivots, and the rows (of the smallest hashes) that they are picked of. They change the speed alone.
PIVOTS, PICKED_OF = 8, 256
#: Squared norms stay below this, so that scores are exact in doubles.
LARGEST_NORM2 = 1 << 52


def _pivots(sample: np.ndarray, lift: np.ndarray, count: int) -> np.ndarray:
    """Rows of a sample that lie far from each other: each the farthest from those before it."""
    x = np.column_stack([sample.astype(np.float64), lift])
    near, out = np.full(len(x), np.inf), [0]
    while len(out) < min(count, len(x)):
        near = np.minimum(near, ((x - x[out[-1]]) ** 2).sum(axis=1))
        out.append(int(near.argmax()))
    return x[out]


def _to_pivots(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of lifted vectors to the pivots."""
    x = x.astype(np.float64)
    return np.sqrt(np.stack([((x - p[:-1]) ** 2).sum(axis=1) + (lift - p[-1]) ** 2 for p in pivots], axis=1))


class Table:
    """Rows with stored pivot distances, in a staged table (key, label, v, far), and what is needed to compare with it."""

    def __init__(self, df: DataFrame, key: str, label: str, vector: str, scale: int):
        spark = df.sparkSession
        held = vectors.whole_vectors(df.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull()), vector, scale, None, key=F.col(f"`{key}`").cast("long"), label=F.col(f"`{label}`").cast("long"))
        most = held.agg(F.max("dim"), F.max("norm2"), F.count("*")).first()
        self.dim, self.norm2, self.rows = most[0] or 0, most[1] or 0, most[2]
        if self.norm2 >= LARGEST_NORM2:
            raise ValueError("vectors are too long for exact scores")
        sample = vectors.unpacked(held.orderBy(F.xxhash64("key"), "v").limit(PICKED_OF).select("v").toArrow().column(0), self.dim)
        self.pivots = _pivots(sample, self.lift(sample), PIVOTS) if len(sample) else np.zeros((0, self.dim + 1))
        dim, lift, pivots = self.dim, self.lift, self.pivots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = vectors.unpacked(batch.column(2), dim)
                far = _to_pivots(x, lift(x), pivots).ravel()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), vectors.packed(far, np.full(len(x), len(pivots)))], names=["key", "label", "v", "far"])

        self.held = C.staged(C.map_arrow(held.select("key", "label", "v"), run, "key long, label long, v binary, far binary"), "pivot-table")
        C.drop_staged(held)
        self.spark = spark

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.norm2 - (x.astype(np.float64) ** 2).sum(axis=1)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("held", "spark")}

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Keys, labels, vectors and pivot distances of blocks of rows, in the order of label and key."""
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                key, label = b.column(0).to_numpy(), b.column(1).to_numpy()
                o = np.lexsort((key, label))
                yield key[o], label[o], vectors.unpacked(b.column(2), self.dim)[o].astype(np.float64), vectors.unpacked(b.column(3), len(self.pivots), np.float64)[o]


class Anchors:
    """A batch of anchors, with their distances to the pivots."""

    def __init__(self, table: Table, rows: pa.Table):
        self.key, self.label = rows.column("key").to_numpy(), rows.column("label").to_numpy()
        v = vectors.unpacked(rows.column("v"), table.dim)
        self.x = v.astype(np.float64)
        self.far = _to_pivots(v, np.zeros(len(v)), table.pivots)
        #: A distance d is a score of (whole - d^2) / 2.
        self.whole = (self.x**2).sum(axis=1) + table.norm2
        self.slack = 1 + 1e-9 * float(table.norm2)

    def brackets(self, own: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the most that the scores of anchors (own) and rows can be, from their distances to the pivots."""
        low, high = np.zeros((len(own), len(far))), np.full((len(own), len(far)), np.inf)
        for p in range(far.shape[1]):
            a, b = self.far[own, p][:, None], far[None, :, p]
            np.maximum(low, np.abs(a - b), out=low)
            np.minimum(high, a + b, out=high)
        whole = self.whole[own][:, None]
        return (whole - high**2) / 2 - self.slack, (whole - low**2) / 2 + self.slack


def best(score: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """The first n by score, ties by the smaller key."""
    if len(score) > 4 * n:
        keep = np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n])
        return keep[np.lexsort((key[keep], -score[keep]))[:n]]
    return np.lexsort((key, -score))[:n]


def _positives(table: Table, q: Anchors, n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a (an anchor's number), key, score of the first n rows of each anchor's label in a task."""
    top = [(np.zeros(0), np.zeros(0, np.int64))] * len(q.key)
    least = np.full(len(q.key), -np.inf)
    by = {x: np.flatnonzero(q.label == x) for x in np.unique(q.label).tolist()}
    for key, label, x, far in table.blocks(batches):
        bounds = np.concatenate([np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]])), [len(label)]])
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            mine = by.get(int(label[lo]), ())
            for at in range(0, len(mine), ANCHORS):
                own = mine[at : at + ANCHORS]
                _, most = q.brackets(own, far[lo:hi])
                stays = most >= least[own][:, None]
                rows = np.flatnonzero(stays.any(axis=0))
                scores = q.x[own] @ x[lo:hi][rows].T
                held = stays[:, rows] & (scores >= least[own][:, None]) & (key[lo:hi][rows][None, :] != q.key[own][:, None])
                for i, a in enumerate(own.tolist()):
                    c = np.flatnonzero(held[i])
                    if len(c):
                        s, k = np.concatenate([top[a][0], scores[i, c]]), np.concatenate([top[a][1], key[lo:hi][rows[c]]])
                        o = best(s, k, n)
                        top[a] = (s[o], k[o])
                        if len(o) == n:
                            least[a] = s[o[-1]]
    n_of = [len(s) for s, _ in top]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(top)), n_of)), pa.array(np.concatenate([k for _, k in top])), pa.array(np.concatenate([s for s, _ in top]).astype(np.int64))], names=["a", "key", "score"])


def _negatives(table: Table, q: Anchors, wanted: list[list[tuple[int, int]]], n: int, low: int, high: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, j (a positive's place), key, score of the first n rows of another label in a task that each positive's band of scores holds. wanted: each anchor's positives' (key, score)."""
    floors = [[-(-low * s // 100) for _, s in w] for w in wanted]
    tops = [[high * s // 100 for _, s in w] for w in wanted]
    held = [[(np.zeros(0), np.zeros(0, np.int64)) for _ in w] for w in wanted]
    bands = [[j for j in range(len(w)) if floors[a][j] <= tops[a][j]] for a, w in enumerate(wanted)]
    need = np.array([min((floors[a][j] for j in b), default=np.inf) for a, b in enumerate(bands)], np.float64)
    roof = np.array([max((tops[a][j] for j in b), default=-np.inf) for a, b in enumerate(bands)], np.float64)
    asks = np.flatnonzero(np.isfinite(need))
    for key, label, x, far in table.blocks(batches):
        for at in range(0, len(asks), ANCHORS):
            own = asks[at : at + ANCHORS]
            least, most = q.brackets(own, far)
            stays = (most >= need[own][:, None]) & (least <= roof[own][:, None]) & (label[None, :] != q.label[own][:, None])
            rows = np.flatnonzero(stays.any(axis=0))
            scores = q.x[own] @ x[rows].T
            fits = stays[:, rows] & (scores >= need[own][:, None]) & (scores <= roof[own][:, None]) & (key[rows][None, :] != q.key[own][:, None])
            for i in np.flatnonzero(fits.any(axis=1)).tolist():
                a, c = int(own[i]), np.flatnonzero(fits[i])
                s, k = scores[i, c], key[rows[c]]
                for j in bands[a]:
                    inside = (s >= floors[a][j]) & (s <= tops[a][j])
                    if inside.any():
                        s2, k2 = np.concatenate([held[a][j][0], s[inside]]), np.concatenate([held[a][j][1], k[inside]])
                        o = best(s2, k2, n)
                        held[a][j] = (s2[o], k2[o])
                need[a] = min(held[a][j][0][-1] if len(held[a][j][0]) == n else floors[a][j] for j in bands[a])
    out = [(a, j, k, s) for a, by in enumerate(held) for j, (ss, ks) in enumerate(by) for s, k in zip(ss.tolist(), ks.tolist(), strict=True)]
    cols = list(zip(*out, strict=True)) or [(), (), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(list(map(int, c)), pa.int64()) for c in cols], names=["a", "j", "key", "score"])


def hard_negatives(df: DataFrame, key: str = "doc_id", label: str = "label", vector: str = "embedding", every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row whose id divides by every, and each of its first rows of the same label, the first rows of another label
    whose score is low to high percent of the positive's."""
    spark, table = df.sparkSession, Table(df, key, label, vector, scale)
    place = new_place(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(place)
    anchors = C.staged(numbered(table.held.where(F.col("key") % every == 0).select("key", "label", "v"), "key", "n"), "anchors")
    count = anchors.count()
    for start in range(0, count, BATCH):
        rows = anchors.where((F.col("n") > start) & (F.col("n") <= start + BATCH)).orderBy("n").toArrow()  # BATCH rows at most
        q = spark.sparkContext.broadcast(Anchors(table, rows))
        found = C.map_arrow(table.held, lambda batches, q=q: _positives(table, q.value, positives, batches), "a long, key long, score long")
        first = Window.partitionBy("a").orderBy(F.desc("score"), "key")
        ranked = found.withColumn("j", F.row_number().over(first)).where(F.col("j") <= positives).orderBy("a", "j").collect()  # BATCH * positives rows at most
        wanted: list[list[tuple[int, int]]] = [[] for _ in range(rows.num_rows)]
        for r in ranked:
            wanted[r.a].append((r.key, r.score))
        sent = spark.sparkContext.broadcast(wanted)
        told = C.map_arrow(table.held, lambda batches, q=q, sent=sent: _negatives(table, q.value, sent.value, negatives, low, high, batches), "a long, j long, key long, score long")
        rank = F.row_number().over(Window.partitionBy("a", "j").orderBy(F.desc("score"), "key"))
        keys = rows.column("key").to_pylist()
        pairs = spark.createDataFrame([(a, j, keys[a], k, s) for a, w in enumerate(wanted) for j, (k, s) in enumerate(w)], "a long, j long, anchor_id long, positive_id long, positive_score long")
        out = told.withColumn("rank", rank).where(F.col("rank") <= negatives).join(F.broadcast(pairs), ["a", "j"])
        out.select("anchor_id", "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(place)
        q.unpersist()
        sent.unpersist()
    C.drop_staged(table.held)
    return spark.read.schema(schema).parquet(place)


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "embeddings")
    return hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))), "vec_id")


OP11_SQL = """WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)),
s AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, coalesce(CAST(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT), 0) AS score FROM x a, x b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS j FROM s WHERE same) WHERE j <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.r, p.j ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score) WHERE rank <= 5"""
