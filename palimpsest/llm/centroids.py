"""Centroid clustering by annulus search.

Centroids are sorted by their norms. A vector's distance to the centroid of the nearest norm bounds how far its own can be; by the triangle inequality a
nearer centroid's norm lies within that bound of the vector's, so two binary searches give the centroids to compare, boundary ties
included. Those are compared exactly, in whole numbers; of equal distances the centroid of the smaller number counts.

Vectors are written once as whole numbers. A round reads them once: each task keeps the sums and counts of its vectors by centroid, which are summed up by Spark;
only centroids (k x dim numbers) pass through the driver. No vector is shuffled, so equal vectors, however many, are no burden.

Null vectors, other lengths, and null or non-finite components are left out. A row without an id is clustered, but never starts a centroid. Repeated rows count each on its own, and
are starting centroids each on their own; of equal hashes the smaller components come first. Fewer vectors than k: as many centroids. No vectors: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import vectors

#: Vectors that are compared with a centroid at a time.
BLOCK = 4096
MOST_CENTROIDS = 1 << 14


class Annuli:
    """Centroids in the order of their norms."""

    def __init__(self, centroids: np.ndarray):
        c = centroids.astype(np.float64)
        norms = np.sqrt((c * c).sum(axis=1))
        self.number = np.argsort(norms, kind="stable")
        self.norms, self.c = norms[self.number], c[self.number]

    def candidates(self, norm: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector: the centroids, by order, whose norms are within bound of its own. Doubles err by less than the slack."""
        slack = 1e-9 * (norm + bound + 1)
        return np.searchsorted(self.norms, norm - bound - slack, "left"), np.searchsorted(self.norms, norm + bound + slack, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each vector's centroid."""
        x = x.astype(np.float64)
        norm = np.sqrt((x * x).sum(axis=1))
        at = np.clip(np.searchsorted(self.norms, norm), 1, max(1, len(self.norms) - 1))
        first = np.clip(np.where(np.abs(self.norms[at - 1] - norm) <= np.abs(self.norms[np.minimum(at, len(self.norms) - 1)] - norm), at - 1, at), 0, len(self.norms) - 1)
        best = ((x - self.c[first]) ** 2).sum(axis=1)
        who = self.number[first].copy()
        lo, hi = self.candidates(norm, np.sqrt(best))
        for j in range(int(lo.min()), int(hi.max())):
            rows = np.flatnonzero((lo <= j) & (j < hi) & (first != j))
            if len(rows):
                d = ((x[rows] - self.c[j]) ** 2).sum(axis=1)
                nearer = (d < best[rows]) | ((d == best[rows]) & (self.number[j] < who[rows]))
                best[rows[nearer]], who[rows[nearer]] = d[nearer], self.number[j]
        return who.astype(np.int32), best.astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, vectors.unpacked(part.column(part.num_columns - 1), dim)


def _moved(held: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: each the floor of its vectors' mean, one without vectors as it was."""
    k, dim = centroids.shape
    annuli = held.sparkSession.sparkContext.broadcast(Annuli(centroids))  # k x dim numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for _, x in _blocks(batches, dim):
            who, _ = annuli.value.nearest(x)
            order = np.argsort(who, kind="stable")
            seen, first, n = np.unique(who[order], return_index=True, return_counts=True)
            sums[seen] += np.add.reduceat(x[order].astype(np.int64), first, axis=0)
            counts[seen] += n
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([[int(counts[i]), *sums[i].tolist()] for i in full], pa.list_(pa.int64()))], names=["cluster", "sums"])

    told = C.map_arrow(held.select("v"), run, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("i", "s"))
    totals = told.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # k x (dim + 1) rows
    annuli.unpersist()
    by = {(r.cluster, r.i): int(r.s) for r in totals}
    out = centroids.copy()
    for c in {c for c, _ in by}:
        out[c] = [by[c, i + 1] // by[c, 0] for i in range(dim)]
    return out


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, key: str = "doc_id", vector: str = "embedding", seed: int = 1) -> DataFrame:
    """key, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector of dim components.

    Centroids start as the k vectors whose `seed:key` has the smallest sha256; k is at most MOST_CENTROIDS, as centroids are broadcast.
    """
    if not 0 < k <= MOST_CENTROIDS:
        raise ValueError(f"1 to {MOST_CENTROIDS} centroids")
    spark = df.sparkSession
    held = vectors.whole_vectors(df, vector, scale, dim, key=F.col(f"`{key}`"))
    start = held.where("key IS NOT NULL").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256), "v").limit(k).select("v").toArrow()
    schema = T.StructType([T.StructField("key", held.schema["key"].dataType), *T._parse_datatype_string("cluster int, distance long").fields])
    out = [F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not start.num_rows:
        return spark.createDataFrame([], schema).selectExpr("*", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256").select(out)
    centroids = vectors.unpacked(start.column(0), dim).astype(np.int64)
    for _ in range(rounds):
        centroids = _moved(held, centroids)
    annuli = spark.sparkContext.broadcast(Annuli(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, dim):
            who, distance = annuli.value.nearest(x)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(who), pa.array(distance)], names=schema.names)

    assigned = C.staged(C.map_arrow(held.select("key", "v"), run, schema), "assigned")
    C.drop_staged(held)
    spread = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    told = [(c, d, sum(spread.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in spread.items()]
    facts = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(out)


def op13_annulus_clusters(spark, sf_dir: str) -> DataFrame:
    return cluster(C.table(spark, sf_dir, "embeddings"), key="vec_id")


def _op13_sql(k: int = 16, rounds: int = 3, dim: int = 64) -> str:
    square = f"list_sum(list_transform(range(1, {dim + 1}), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))"
    steps = [
        f"""x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim})""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256(concat('1:', vec_id)), v) - 1 AS INTEGER) AS cluster, v FROM x WHERE vec_id IS NOT NULL ORDER BY 1 LIMIT {k})",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT x.r, c.cluster, CAST({square} AS BIGINT) AS d FROM x, c{n} c) GROUP BY r)")
        if n < rounds:
            steps.append(
                f"""c{n + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (SELECT cluster, list(q ORDER BY i) AS v FROM
  (SELECT cluster, i, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS q FROM (SELECT a.cluster, x.v, unnest(range(1, {dim + 1})) AS i FROM x JOIN a{n} a USING (r)) GROUP BY cluster, i) GROUP BY cluster) m USING (cluster))"""
            )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM x JOIN a{rounds} USING (r) JOIN c{rounds} c USING (cluster)"""


OP13_SQL = _op13_sql()
