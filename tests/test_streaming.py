from palimpsest.operators import certificates, history
from palimpsest.sources import captures as src
from palimpsest.streaming import events


def test_stream_equals_batch(spark, sf, tmp_path):
    batch = src.captures(spark, sf).select(events.COLUMNS)
    bounds = batch.approxQuantile("committed_ms", [0.3, 0.7], 0.0)
    for i, cond in enumerate((f"committed_ms < {bounds[0]}", f"committed_ms >= {bounds[0]} AND committed_ms < {bounds[1]}", f"committed_ms >= {bounds[1]}")):
        batch.where(cond).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        if i < 2:
            continue
        events.write_batches(events.stream_events(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        q = events.stream_certificate_changes(stream).writeStream.format("memory").queryName("changes").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.crawl_result_id: r.update_bitfield for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.crawl_result_id: r.update_bitfield for r in history.with_events(batch).collect()}
    verified = src.certificates(spark, sf)
    q = events.stream_certificate_changes(stream, verified).writeStream.format("memory").queryName("alerts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    columns = ["host_id", "crawl_result_id", "previous_crawl_result_id", "certificate_id", "previous_certificate_id", "observed_ms"]
    assert sorted(map(tuple, spark.table("alerts").select(columns).collect())) == sorted(map(tuple, certificates.changes(batch, verified).select(columns).collect()))
    none = src.certificates(spark, sf).selectExpr("certificate_id", "fp", "false AS pkix_verified")
    assert spark.table("changes").count() == certificates.changes(batch, none).count()
