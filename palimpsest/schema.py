"""Types and constants of the capture archive. Times are Unix milliseconds; digests are 32 bytes."""

from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

#: Who may see a capture: a bit for each audience.
MODES = {"legacy": 1, "indexer": 2, "archiver": 4, "researcher": 8, "webproxy": 16}
ALL_MODES = 31
#: Names of audiences in requests.
MODE_NAMES = {"archive": 4, "index": 2, "research": 8, "legacy": 1, "webproxy": 16}
#: Why a page is queued.
REASONS = {"discovered": 1, "submitted": 2, "watched": 4, "retry": 8, "robots": 16}
#: What makes a page be fetched again by itself; all subscribed feeds share a bit.
TARGETS = {"homepage": 1, "gemsub": 2, "feed": 4, "security": 8}
MOST_ROWS, MOST_HOPS, DEFAULT_HOPS = 1001, 64, 16
BATCH_BYTES = 64 << 20


def _s(**fields) -> StructType:
    return StructType([StructField(k.rstrip("_"), t, k.endswith("_")) for k, t in fields.items()])


L, I, S, B, Z = LongType(), IntegerType(), StringType(), BinaryType(), BooleanType()
#: A trailing underscore marks a column that may be null.
CAPTURES = _s(crawl_result_id=L, page_id=L, redirected_to_page_id_=L, redirect_count=I, certificate_id_=L, started_ms=L, ended_ms=L, committed_ms=L, status_code_=I, robots_bitfield=I, object_id_=L, meta_=S)
PAGES = _s(page_id=L, url=S, host_id=L, first_seen_ms=L, latest_crawl_result_id_=L)
HOSTS = _s(host_id=L, authority=S, status_code=I, polite_after_ms_=L, retry_after_ms_=L, consecutive_failures=I, last_error_code_=I, last_success_ms_=L, last_failure_ms_=L)
CERTIFICATES = _s(certificate_id=L, blake2b_256=B, certificate=B, pkix_verified=Z)
OBJECTS = _s(object_id=L, blake2b_256=B, raw_bytes=L, created_ms=L)
BODIES = _s(blake2b_256=B, raw_bytes=L, format=I, data=B)
QUEUE = _s(page_id=L, host_id=L, state_code=I, reason_bitfield=I, ready_at_ms=L, claimed_at_ms_=L, attempt_count=I)
WATCHED = _s(page_id=L, added_at_ms=L, next_enqueue_ms=L)
AUTOMATIC = _s(page_id=L, target_bitfield=I, first_recognized_ms=L, last_recognized_ms=L, next_enqueue_ms=L)
FEEDS = _s(page_id=L, feed_type=S, first_recognized_ms=L, last_recognized_ms=L)
SECURITY = _s(page_id=L, first_seen_ms=L, last_seen_ms=L)
ROBOTS = _s(host_id=L, robots_page_id=L, robots_crawl_result_id_=L, checked_ms=L, expires_ms=L, parser_version=I, compiled_rules_=B)
CLIENTS = _s(client_id=L, label=S, fingerprint=S, modes=I, revoked=Z)
