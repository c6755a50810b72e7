"""A capture history over the ``events`` table, and its dimensions: the same expressions in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CAPTURES = """
SELECT event_id + 1 AS crawl_result_id, user_id AS page_id, user_id % 10 AS host_id,
  CASE WHEN event_type IN ('signup', 'purchase') THEN (user_id + k) % n END AS redirected_to_page_id,
  CAST(CASE WHEN event_type IN ('signup', 'purchase') THEN 1 ELSE 0 END AS BIGINT) AS redirect_count,
  CASE WHEN k % 5 = 0 THEN NULL ELSE (user_id % 10) * 4 + (k % 4) END AS certificate_id,
  ms - k * 100 AS started_ms, ms - k * 50 AS ended_ms, ms AS committed_ms,
  CAST(CASE event_type WHEN 'error' THEN 51 WHEN 'signup' THEN 31 WHEN 'purchase' THEN 30 ELSE 20 END AS BIGINT) AS status_code,
  k % 32 AS robots_bitfield,
  CASE WHEN event_type IN ('view', 'click') THEN k % 7 END AS object_id,
  CASE WHEN event_type IN ('view', 'click') THEN (k % 7) * 1000 END AS raw_bytes,
  CASE event_type WHEN 'view' THEN 'text/gemini; charset=utf-8' WHEN 'click' THEN 'Text/Plain' WHEN 'error' THEN 'Not found' ELSE '/moved' END AS meta
FROM e"""
_PAGES = "SELECT page_id, host_id, concat('gemini://h', CAST(host_id AS STRING), '.test/', CAST(page_id AS STRING)) AS url, min(committed_ms) AS first_seen_ms, max(crawl_result_id) AS latest_crawl_result_id FROM captures GROUP BY page_id, host_id"
_CERTS = "SELECT certificate_id, concat('cert-', CAST(certificate_id AS STRING)) AS fp, certificate_id % 3 = 0 AS pkix_verified FROM captures WHERE certificate_id IS NOT NULL GROUP BY certificate_id"
_HOSTS = "SELECT host_id, concat('h', CAST(host_id AS STRING), '.test:1965') AS authority FROM captures GROUP BY host_id"
_REQUESTS = "SELECT page_id, host_id, CAST(crawl_result_id % 5 AS INT) AS b, committed_ms AS ready_at_ms, CAST(CASE WHEN crawl_result_id % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS state_code FROM captures"


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """crawl_result_id, page_id, host_id, redirected_to_page_id, redirect_count, certificate_id, three clocks, status_code, robots_bitfield, object_id, raw_bytes, meta."""
    events = table(spark, sf_dir, "events")
    n = events.agg(F.countDistinct("user_id").alias("n"))  # one row
    e = events.select("event_id", "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.get_json_object("props", "$.k").cast("long").alias("k")).crossJoin(F.broadcast(n))
    return spark.sql(_CAPTURES.replace("FROM e", "FROM {e}"), e=e)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PAGES.replace("FROM captures", "FROM {c}"), c=captures(spark, sf_dir))


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_CERTS.replace("FROM captures", "FROM {c}"), c=captures(spark, sf_dir))


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_HOSTS.replace("FROM captures", "FROM {c}"), c=captures(spark, sf_dir))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host_id, reason, ready_at_ms, state_code (0 ready, 1 claimed): a request for each capture."""
    r = spark.sql(_REQUESTS.replace("FROM captures", "FROM {c}"), c=captures(spark, sf_dir))
    return r.select("page_id", "host_id", F.expr("CAST(shiftleft(1, b) AS BIGINT)").alias("reason"), "ready_at_ms", "state_code")


#: The same for DuckDB, as the start of a query; the archive's pages are called cap_pages there.
PRELUDE = f"""WITH e AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, (SELECT count(DISTINCT user_id) FROM events) AS n FROM events
), captures AS ({_CAPTURES}
), cap_pages AS ({_PAGES}
), certs AS ({_CERTS}
), hosts AS ({_HOSTS}
), requests AS (
  SELECT page_id, host_id, CAST(1 << b AS BIGINT) AS reason, ready_at_ms, state_code FROM ({_REQUESTS})
), ev AS (
  SELECT *, CAST((((robots_bitfield & ~p) | (p & ~robots_bitfield)) | CASE WHEN same THEN 0 ELSE robots_bitfield & p END) & 31 AS BIGINT) AS update_bitfield FROM (
    SELECT *, lag(robots_bitfield, 1, CAST(0 AS BIGINT)) OVER h AS p,
      status_code IS NOT DISTINCT FROM lag(status_code) OVER h AND redirected_to_page_id IS NOT DISTINCT FROM lag(redirected_to_page_id) OVER h
      AND redirect_count IS NOT DISTINCT FROM lag(redirect_count) OVER h AND object_id IS NOT DISTINCT FROM lag(object_id) OVER h AND meta IS NOT DISTINCT FROM lag(meta) OVER h AS same
    FROM captures WINDOW h AS (PARTITION BY page_id ORDER BY committed_ms, crawl_result_id))
), queue AS (
  SELECT page_id, min(host_id) AS host_id, CAST(bit_or(reason) AS BIGINT) AS reason, min(ready_at_ms) AS ready_at_ms, min(state_code) AS state_code FROM requests GROUP BY page_id
)
"""
