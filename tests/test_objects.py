import uuid

import pytest

from palimpsest.operators import objects
from palimpsest.sources import warc


WANTED = "position long, blake2b_256 binary, raw_bytes long"


def test_store(spark):
    none = spark.createDataFrame([], "blake2b_256 binary, raw_bytes long, format int, data binary")
    long = b"the same line again\n" * 400
    store = objects.put(none, spark.createDataFrame([(b"a short note",), (long,), (b"",), (long,)], "body binary")).cache()
    assert sorted((r.raw_bytes, r.format) for r in store.collect()) == [(0, objects.PLAIN), (12, objects.PLAIN), (len(long), objects.ZSTD)]
    assert objects.put(store, spark.createDataFrame([(b"",), (b"one more",)], "body binary")).count() == 4
    key = {r.raw_bytes: bytes(r.blake2b_256) for r in store.collect()}
    want = spark.createDataFrame([(7, key[len(long)], len(long)), (2, key[12], 12), (5, key[len(long)], len(long))], WANTED)
    got = objects.get_many(store, want)
    assert {r.position: bytes(r.body) for r in got.collect()} == {7: long, 2: b"a short note", 5: long}
    assert objects.verified(got).count() == 3
    assert [r.present for r in objects.exists(store, want.union(spark.createDataFrame([(9, b"?", 1)], WANTED))).orderBy("position").collect()] == [True, True, True, False]


@pytest.mark.parametrize(("digest", "size"), [(b"nowhere", 1), (None, 13)])
def test_store_refuses(spark, digest, size):
    none = spark.createDataFrame([], "blake2b_256 binary, raw_bytes long, format int, data binary")
    store = objects.put(none, spark.createDataFrame([(b"a short note",)], "body binary"))
    own = bytes(store.first().blake2b_256)
    with pytest.raises(Exception, match="object"):
        objects.get_many(store, spark.createDataFrame([(0, digest or own, size)], WANTED)).collect()
    with pytest.raises(Exception, match="disagrees"):
        objects.verified(spark.createDataFrame([(own, b"another note")], "blake2b_256 binary, body binary")).collect()


def test_warc(spark):
    import zstandard

    r = objects.warc_record("gemini://h/", b"body", 1704067200999, uuid.UUID(int=1))
    assert r == (
        b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: gemini://h/\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:uuid:00000000-0000-0000-0000-000000000001>\r\n"
        b"Content-Type: application/octet-stream\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    )
    with pytest.raises(ValueError):
        objects.warc_record("a\nb", b"", 0)


def unpacked(*files):
    import io

    import zstandard

    data = b"".join(files)
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as z:
        return list(warc.records(io.BufferedReader(z)))


def test_batch_is_one_stream(spark):
    """The manifest first, dated by the final row, then what is included, in order."""
    rows = spark.createDataFrame([("gemini://h/#x", b"one", "included", 1_704_067_201_999, 4), ("gemini://h/2", b"no", "excluded_by_body_mime", 1_704_067_203_000, 6), ("gemini://h/0", b"zero", "included", 1_704_067_200_000, 9)], "url string, body binary, body_state string, committed_ms long, crawl_result_id long")
    document = spark.createDataFrame([('{"results":[]}', 1_704_067_203_000)], "json string, committed_ms long")
    (row,) = objects.warc_batch(rows, document).collect()
    got = [(h["WARC-Target-URI"], h["WARC-Date"], b) for h, b in unpacked(bytes(row.data))]
    assert got == [(objects.MANIFEST, "2024-01-01T00:00:03Z", b'{"results":[]}'), ("gemini://h/0", "2024-01-01T00:00:00Z", b"zero"), ("gemini://h/", "2024-01-01T00:00:01Z", b"one")]
    assert objects.warc_batch(rows.limit(0), document.limit(0)).count() == 0


def exported(spark, n):
    return spark.range(n).selectExpr("concat('gemini://h/', id) AS url", "CASE WHEN id % 7 > 0 THEN encode(repeat(concat('line ', id, '\n'), cast(id % 50 AS int)), 'UTF-8') END AS body", "1704067200000 + id * 1000 AS committed_ms", "id AS crawl_result_id")


def test_export(spark, tmp_path):
    """Bytes come back equal, the manifest tells all parts and is dated by the final row, which may have no body; empty tasks write nothing."""
    import json

    warc.register(spark)
    place, df = str(tmp_path / "out"), exported(spark, 500).repartition(6)
    df.write.format("warc").option("mode", "researcher").mode("append").save(place)
    back = spark.read.format("warc").load(place)
    assert sorted(map(tuple, back.select("url", "body", "committed_ms").collect())) == sorted(map(tuple, df.where("body IS NOT NULL").select("url", "body", "committed_ms").collect()))
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names[0].startswith("manifest-") and all(n.endswith(warc.END) for n in names)
    whole = unpacked(*[(tmp_path / "out" / n).read_bytes() for n in names])
    told = json.loads(whole[0][1])
    assert whole[0][0]["WARC-Date"] == "2024-01-01T00:08:19Z" and len(whole) == 1 + told["records"] == 1 + df.where("body IS NOT NULL").count()
    assert [p["name"] for p in told["parts"]] == names[1:] and told["mode"] == "researcher" and max(p["last"]["crawl_result_id"] for p in told["parts"]) <= 499
    df.where("crawl_result_id = 1").repartition(3).write.format("warc").mode("overwrite").save(place)
    assert spark.read.format("warc").load(place).count() == 1 and len(list((tmp_path / "out").iterdir())) == 2


def test_export_that_fails_leaves_no_file(spark, tmp_path):
    from pyspark.sql import functions as F

    warc.register(spark)
    place = tmp_path / "out"
    bad = exported(spark, 300).repartition(4).withColumn("url", F.when(F.col("crawl_result_id") == 255, "two\nlines").otherwise(F.col("url")))
    with pytest.raises(Exception, match="invalid WARC target"):
        bad.write.format("warc").mode("append").save(str(place))
    assert not list(place.rglob("*"))


def test_digest_collisions(spark, monkeypatch):
    """Bodies of one digest are compared: among the new ones, and with what is stored."""
    none = spark.createDataFrame([], "blake2b_256 binary, raw_bytes long, format int, data binary")
    body = lambda *b: spark.createDataFrame([(x,) for x in b], "body binary")
    store = objects.put(none, body(b"first"))
    from pyspark.sql import functions as F

    alike = lambda c: F.encode(F.lit("0" * 32), "UTF-8")
    monkeypatch.setattr(objects, "blake2b_256", alike)
    with pytest.raises(Exception, match="digest collision"):
        objects.put(none, body(b"first", b"second")).collect()
    same = store.withColumn("blake2b_256", alike("x"))
    assert objects.put(same, body(b"first", b"first")).count() == 1
    with pytest.raises(Exception, match="digest collision"):
        objects.put(same, body(b"other")).collect()


def test_bodies_are_encoded_in_pieces():
    """A worker holds one piece of what it gives back, not all of a batch."""
    import os

    import pyarrow as pa

    bodies = [os.urandom(1 << 20) for _ in range(12)] + [b"", b"x" * (9 << 20)]
    out = list(objects.encode.func(iter([pa.array(bodies, pa.binary())])))
    assert len(out) > 2 and sum(map(len, out)) == 14
    assert all(sum(len(r["data"]) for r in a[:-1].to_pylist()) < objects.PIECE for a in out)
    assert [r["format"] for a in out for r in a.to_pylist()] == [objects.PLAIN] * 13 + [objects.ZSTD]


def test_bodies_are_decoded_in_pieces():
    import pyarrow as pa
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    bodies = [bytes([k]) * (1 << 20) for k in range(13)]
    stored = pa.array([objects.ZSTD] * 13), pa.array([z.compress(b) for b in bodies], pa.binary()), pa.array([1 << 20] * 13, pa.int64())
    out = list(objects.decode.func(iter([stored])))
    assert len(out) > 2 and [x.as_py() for a in out for x in a] == bodies
    assert all(a.nbytes <= objects.PIECE + (1 << 20) for a in out)


def test_digests_are_computed_once(spark, tmp_path):
    """Not again for each "is not null" that is inferred of a key: that takes one more worker, which holds a batch of bodies."""
    spark.createDataFrame([(1, b"a"), (2, b"b")], "position long, body binary").write.parquet(str(tmp_path / "bodies"))
    bodies = spark.read.parquet(str(tmp_path / "bodies"))
    none = spark.createDataFrame([], "blake2b_256 binary, raw_bytes long, format int, data binary")
    wanted = bodies.select("position", objects.blake2b_256("body").alias("blake2b_256"), bodies.body.cast("string").alias("s")).selectExpr("position", "blake2b_256", "cast(length(s) AS long) AS raw_bytes")
    got = objects.get_many(objects.put(none, bodies.select("body")), wanted)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython [blake2b_256(") == 4  # what is put and wanted, and what is wanted of the old store and of the new bodies
    assert {r.position: bytes(r.body) for r in got.collect()} == {1: b"a", 2: b"b"}
