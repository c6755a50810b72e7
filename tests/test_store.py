"""Commits of several tables: all or nothing, once for each batch, one winner."""

import pytest

from pyspark.sql import functions as F

from palimpsest.sources.store import Append, Conflict, Merge, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s", {"queue": "page_id"}, buckets=8)


def queue(spark, rows):
    return spark.createDataFrame(rows, "page_id long, reason long")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_tables_change_together(spark, store):
    assert store.manifest()["version"] == 0 and store.read("queue") is None and store.state() == {}
    assert store.commit({"queue": Merge(queue(spark, [(i, 1) for i in range(20)])), "log": Append(spark.range(3))}, facts={"clock": 5}) == 1
    assert store.commit({"queue": Merge(queue(spark, [(3, 9), (40, 2)]), spark.createDataFrame([(7,), (99,)], "page_id long")), "log": Append(spark.range(3, 5))}) == 2
    assert rows(store.read("queue")) == sorted([(i, 9 if i == 3 else 1) for i in range(20) if i != 7] + [(40, 2)])
    assert rows(store.read("log")) == [(i,) for i in range(5)] and store.manifest()["facts"] == {"clock": 5}
    assert rows(store.read("queue", 1)) == [(i, 1) for i in range(20)] and rows(store.read("log", 1)) == [(0,), (1,), (2,)]
    assert rows(store.look_up("queue", 3)) == [(3, 9)] and len({f.rsplit("/", 2)[1] for f in store.look_up("queue", 3).inputFiles()}) == 1


def test_buckets_that_are_not_touched_stay(spark, store):
    store.commit({"queue": Merge(queue(spark, [(i, 1) for i in range(100)]))})
    before = store.manifest()["tables"]["queue"]["parts"]
    store.commit({"queue": Merge(queue(spark, [(5, 2)]))})
    after = store.manifest()["tables"]["queue"]["parts"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(rows(store.read("queue"))) == 100
    store.commit({"queue": Merge(queue(spark, []), spark.range(100).select(F.col("id").alias("page_id")))})
    assert rows(store.read("queue")) == [] and store.read("queue").columns == ["page_id", "reason"]


def test_a_commit_that_dies_changes_nothing(spark, store):
    """Between the first table and the second: readers have the version before, and the next commit builds on it."""
    store.commit({"queue": Merge(queue(spark, [(1, 1)])), "log": Append(spark.range(1))})
    bad = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("executor lost")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="executor lost"):
        store.commit({"queue": Merge(queue(spark, [(2, 2)])), "log": Append(bad)}, "w", 0)
    assert store.manifest()["version"] == 1 and rows(store.read("queue")) == [(1, 1)] and rows(store.read("log")) == [(0,)]
    assert store.commit({"queue": Merge(queue(spark, [(2, 2)])), "log": Append(spark.range(9, 10))}, "w", 0) == 2
    assert rows(store.read("queue")) == [(1, 1), (2, 2)] and rows(store.read("log")) == [(0,), (9,)]
    assert store.vacuum() > 0 and rows(store.read("queue")) == [(1, 1), (2, 2)] and store.versions() == [2]


def test_a_batch_is_committed_once(spark, store):
    for batch, want in ((0, 1), (0, 1), (1, 2), (0, 2), (1, 2)):
        assert store.commit({"log": Append(spark.range(2))}, "stream", batch) == want
    assert store.commit({"log": Append(spark.range(2))}, "other", 0) == 3 and store.read("log").count() == 6
    assert store.compact("log", ("id",)) == 4 and store.read("log").count() == 6 and len(store.manifest()["tables"]["log"]["parts"][""]) == 1


def test_one_of_two_writers_wins(spark, store):
    store.commit({"log": Append(spark.range(1))})
    store.commit({"log": Append(spark.range(1, 2))}, base=1)
    with pytest.raises(Conflict):
        store.commit({"log": Append(spark.range(2, 3))}, base=1)
    assert rows(store.read("log")) == [(0,), (1,)] and store.versions() == [1, 2]


def scanned(df):
    """Rows that a query's scans have given, after row groups were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_look_ups_read_few_row_groups(spark, tmp_path):
    """By the key, by a column with a Bloom filter, and by the column that a growing table's buckets go by; its folders add up and can be made one."""
    pages = spark.range(40_000).selectExpr("concat('gemini://h', id % 97, '/', sha2(cast(id AS string), 256)) AS url", "xxhash64(id) AS page_id", "repeat(sha2(cast(id AS string), 512), 2) AS pad")
    store = Store(spark, f"file://{tmp_path}/p", {"pages": "url"}, 4, {"pages": ("page_id",)}, row_group_bytes=64 << 10)
    store.commit({"pages": Merge(pages)})
    row = pages.where("page_id = xxhash64(777L)").first()
    by_url = store.look_up("pages", row.url)
    assert by_url.first() == row and scanned(by_url) < 1500
    by_id = store.read("pages").where(F.col("page_id") == row.page_id)
    assert by_id.first() == row and scanned(by_id) < 4000
    assert scanned(store.read("pages").where(F.col("pad") == row.pad)) > 10_000  # what has neither order nor filter

    captures = lambda lo: spark.range(lo, lo + 20_000).selectExpr("id % 500 AS page_id", "id AS crawl_result_id", "repeat(sha2(cast(id AS string), 512), 2) AS pad")
    for lo in (0, 20_000):
        store.commit({"captures": Append(captures(lo), ("page_id", "crawl_result_id"), "page_id")})
    for _ in range(2):
        found = store.look_up("captures", 123)
        assert sorted(r.crawl_result_id for r in found.collect()) == list(range(123, 40_000, 500)) and scanned(found) < 6000
        store.compact("captures", ("page_id", "crawl_result_id"))
