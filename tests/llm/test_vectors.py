"""Operators on embeddings against plain searches over all rows, and on odd rows."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import centroids, hardneg, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, v string, key int"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    """Rows (id, vector, label) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, y, 1, "x", 0) for i, v, y in rows], SCHEMA)


def test_whole_numbers():
    col = pa.array([[0.5, -0.01], None, [], [1.0, None], [NAN, 1.0], [INF, 0.0], [0.25, 0.26, -1.0]], pa.list_(pa.float32()))
    ok, x, n = vectors.quantised(col, 64)
    assert ok.tolist() == [True, False, True, False, False, False, True] and n.tolist() == [2, 0, 3] and x.tolist() == [32, -1, 16, 16, -64]
    assert vectors.quantised(col.slice(6), 64)[1].tolist() == [16, 16, -64]
    assert vectors.quantised(col, 64, 2)[0].tolist() == [True] + [False] * 6
    assert vectors.unpacked(vectors.packed(x, n), 3).tolist() == [[32, -1, 0], [0, 0, 0], [16, 16, -64]]
    with pytest.raises(ValueError, match="too large"):
        vectors.quantised(pa.array([[1e9]], pa.list_(pa.float32())), 64)


# 13 centroid clustering


def test_annuli_against_brute_force():
    """The nearest of all centroids, ties by number, whatever the norms; and no annulus leaves it out."""
    rng = np.random.default_rng(2)
    for spread in (1, 3, 40):
        c = rng.integers(-spread, spread + 1, (23, 5))
        c[7], c[11] = c[3], -c[3]
        x = np.concatenate([rng.integers(-spread, spread + 1, (300, 5)), c, np.zeros((1, 5), int)])
        who, d = centroids.Annuli(c).nearest(x)
        far = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (who == far.argmin(axis=1)).all() and (d == far.min(axis=1)).all()
    one = centroids.Annuli(np.array([[3, 4]])).nearest(np.array([[0, 0], [3, 4]]))
    assert one[0].tolist() == [0, 0] and one[1].tolist() == [25, 0]


def test_annuli_prune():
    """Where norms differ, few centroids are compared."""
    c = np.array([[10 * i, 0] for i in range(1, 101)])
    a = centroids.Annuli(c)
    x = c[::7] + 1
    lo, hi = a.candidates(np.sqrt((x.astype(float) ** 2).sum(axis=1)), np.full(len(x), math.sqrt(2)))
    assert (hi - lo <= 2).all() and (lo <= np.arange(0, 100, 7)).all() and (hi > np.arange(0, 100, 7)).all()


def plain_clusters(rows, k, rounds, dim, scale=64):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, _ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        by = {}
        for _, v in kept:
            by.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(by[j]) for x in zip(*by[j])] if j in by else w for j, w in enumerate(c)]
    got = [(i, *near(v)[::-1]) for i, v in kept]
    total = {j: sum(d for _, w, d in got if w == j) for j in range(k)}
    return sorted([(i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in got], key=str)


@pytest.fixture(scope="module")
def odd_rows():
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1 + i % 3, 4).round(2).tolist(), i % 3) for i in range(300)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5], 0) for i in range(300, 420)]  # a third of all rows are alike
    rows += [(7, rows[7][1], 7 % 3), (7, rows[7][1], 7 % 3), (7, [9.0, 9.0, 9.0, 9.0], 1), (100, rows[100][1], 1), (200, [0.0, 0.0, 0.0, 0.0], 2)]
    return rows + [(None, [1.0, 1.0, 1.0, 1.0], 1), (500, None, 1), (600, [1.0, None, 1.0, 1.0], 1), (700, [1.0, NAN, 1.0, 1.0], 1), (800, [1.0], 1), (900, [1.0, 2.0, 3.0, 4.0], None), (1000, [], 1)]


def test_clusters_against_brute_force(spark, odd_rows):
    df = frame(spark, odd_rows)
    for parts in (1, 7):
        got = centroids.cluster(df.repartition(parts), 9, 3, 4, key="vec_id")
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(odd_rows, 9, 3, 4)


def test_few_vectors(spark, odd_rows):
    df = frame(spark, odd_rows[:3])
    assert sorted(map(tuple, centroids.cluster(df, 9, 3, 4, key="vec_id").collect()), key=str) == plain_clusters(odd_rows[:3], 9, 3, 4)
    for none in (df.limit(0), df.where("FALSE"), df.withColumn("vec_id", df.vec_id + 1).where("vec_id > 50")):
        got = centroids.cluster(none, 9, 3, 4, key="vec_id")
        assert got.columns[0] == "vec_id" and got.count() == 0
    with pytest.raises(ValueError):
        centroids.cluster(df, 0)


# 11 hard negatives


def plain_negatives(rows, every=100, n=5, scale=256):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q, y in kept:
        if i % every:
            continue
        others = sorted((-sum(a * b for a, b in zip(q, v)), k, z) for k, v, z in kept if k != i)
        for s, k, _ in [o for o in others if o[2] == y][:n]:
            fits = [o for o in others if o[2] != y and 80 * -s <= 100 * -o[0] <= 100 * -s][:n]
            out += [(i, k, r + 1, m, -s, -t) for r, (t, m, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize(("batch", "block", "pivots"), [(1 << 14, 8192, 8), (2, 16, 3), (3, 50, 1)])
def test_negatives_against_brute_force(spark, odd_rows, monkeypatch, batch, block, pivots):
    """Whatever the batches, blocks and pivots are."""
    monkeypatch.setattr(hardneg, "BATCH", batch)
    monkeypatch.setattr(hardneg, "ROWS", block)
    monkeypatch.setattr(hardneg, "ANCHORS", 2)
    monkeypatch.setattr(hardneg, "PIVOTS", pivots)
    want = plain_negatives(odd_rows, 25)
    got = hardneg.hard_negatives(frame(spark, odd_rows).repartition(3), "vec_id", every=25)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    assert dict(got.dtypes)["rank"] == "int"


def test_negatives_of_nothing(spark, odd_rows):
    df = frame(spark, odd_rows)
    for none in (df.limit(0), df.where("vec_id % 100 <> 0"), df.where("vec_id = 100"), df.where("label = 1"), df.where("embedding IS NULL")):
        assert hardneg.hard_negatives(none, "vec_id").count() == 0


def test_brackets_hold(spark):
    """Every score lies in its bracket, and brackets leave half of the rows out where rows lie in tight groups."""
    rng = np.random.default_rng(6)
    mid = rng.normal(0, 200, (20, 16))
    x = np.floor(np.concatenate([m + rng.normal(0, 1, (50, 16)) for m in mid])).astype(np.int32)
    t = hardneg.Table.__new__(hardneg.Table)
    t.dim, t.norm2 = 16, int((x.astype(np.int64) ** 2).sum(axis=1).max())
    t.pivots = hardneg._pivots(x[::7], t.lift(x[::7]), 8)
    q = hardneg.Anchors(t, pa.table({"key": pa.array(range(0, 1000, 100)), "label": pa.array([0] * 10), "v": vectors.packed(x[::100].ravel(), np.full(10, 16))}))
    low, high = q.brackets(np.arange(10), hardneg._to_pivots(x, t.lift(x), t.pivots))
    score = x[::100].astype(np.int64) @ x.T.astype(np.int64)
    assert (low <= score).all() and (score <= high).all()
    best = np.sort(score, axis=1)[:, -5][:, None]
    assert (high >= best).mean() < 0.5


def test_first_rows():
    score, key = np.array([3.0, 5, 5, 1, 5, 4] * 9), np.arange(54)[::-1].copy()
    want = sorted(range(54), key=lambda i: (-score[i], key[i]))
    for n in (1, 5, 13, 54):
        assert hardneg.best(score, key, n).tolist() == want[:n]
