"""What a batch of completed fetches changes, in all tables, as one commit.

A batch has fetches (crawls) in an order, each of which ends a claim, and robots captures after them. Rows are judged as if they came one by one: what an earlier one of the batch has made is
there for the later ones. Here that order is a column, and all rows are judged at once: every table's changes are aggregates over what the batch says of a key, by order. Only keys of the
batch are read from the tables, and only they change. Pages, hosts, objects and certificates that are new are numbered after the known ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ALL_MODES, REASONS, TARGETS
from ..session import kept, scratch
from ..sources.store import Append, Merge, Store
from . import catalog
from .frontier import numbered

ADDRESS = "struct<url:string,authority:string>"
_RESULT = "seq long, url string, authority string, redirect_url string, redirect_authority string, redirect_count long, cert_digest binary, certificate binary, cert_verified boolean, started_ms long, ended_ms long, status_code long, robots_bitfield long, object_digest binary, meta string"
#: Fetches. queue_page_id: the claim; targets: why the page is fetched again by itself (0: not at all); probes: where a security.txt may be; links: pages found; retry_ms: null ends the claim.
CRAWLS = f"{_RESULT}, queue_page_id long, retire boolean, evaluated boolean, targets long, next_enqueue_ms long, feed_type string, security_evaluated boolean, has_security boolean, probes array<{ADDRESS}>, links array<{ADDRESS}>, retry_ms long"
ROBOTS = f"{_RESULT}, policy string, cache boolean, checked_ms long, expires_ms long"
#: All tables, and the key of each that doesn't only grow.
TABLES = {
    "hosts": "host_id long, authority string",
    "pages": "page_id long, url string, host_id long, first_seen_ms long, latest_crawl_result_id long",
    "objects": "object_id long, blake2b_256 binary, raw_bytes long, created_ms long",
    "certificates": "certificate_id long, blake2b_256 binary, certificate binary, pkix_verified boolean",
    "events": "crawl_result_id long, page_id long, host_id long, redirected_to_page_id long, redirect_count long, certificate_id long, started_ms long, ended_ms long, committed_ms long, status_code long, robots_bitfield long, object_id long, raw_bytes long, meta string, update_bitfield long",
    "heads": "page_id long, committed_ms long, crawl_result_id long, robots_bitfield long, object_id long, redirected_to_page_id long, redirect_count long, status_code long, meta string",
    "queue": "page_id long, host_id long, state_code long, reason long, ready_at_ms long",
    "automatic": "page_id long, target_bitfield long, first_recognized_ms long, last_recognized_ms long, next_enqueue_ms long",
    "feeds": "page_id long, feed_type string, first_recognized_ms long, last_recognized_ms long",
    "security": "page_id long, first_seen_ms long, last_seen_ms long",
    "robots": "host_id long, robots_page_id long, robots_crawl_result_id long, checked_ms long, expires_ms long, parser_version long, compiled_rules string",
}
KEYS = {"hosts": "authority", "pages": "url", "objects": "blake2b_256", "certificates": "blake2b_256", "heads": "page_id", "queue": "page_id", "automatic": "page_id", "feeds": "page_id", "security": "page_id", "robots": "host_id"}
#: Tables that rows are looked up in by more than their key.
BLOOMS = {"pages": ("page_id",), "objects": ("object_id",), "certificates": ("certificate_id",), "captures": ("crawl_result_id",)}
MOST_META, MOST_POLICY = 1024, 64 << 10


class Refused(ValueError):
    """A batch that breaks a rule; nothing of it is committed."""


def empty_state(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


def _checked(*rules: tuple[str, DataFrame]) -> None:
    """Raises for the first row that any rule (what is wrong, the rows that it is wrong with) finds."""
    told = None
    for k, (what, rows) in enumerate(rules):
        one = rows.select(F.lit(k).alias("k"), F.lit(what).alias("what")).limit(1)
        told = one if told is None else told.union(one)
    if bad := told.orderBy("k").limit(1).collect():
        raise Refused(bad[0].what)


_blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
#: Rules that a capture must keep by itself, and what breaks each; and those of robots captures besides.
RULES = {
    "a crawl result requires a page URL and authority": lambda: _blank("url") | _blank("authority"),
    "a redirect target requires a URL and authority": lambda: F.col("redirect_url").isNotNull() & (_blank("redirect_url") | _blank("redirect_authority")),
    "redirect_count cannot be negative": lambda: F.col("redirect_count") < 0,
    "crawl result ends before it starts": lambda: F.col("ended_ms") < F.col("started_ms"),
    "robots_bitfield contains an unknown use bit": lambda: F.col("robots_bitfield").bitwiseAND(~ALL_MODES) != 0,
    "meta exceeds 1024 bytes": lambda: F.octet_length("meta") > MOST_META,
}
ROBOTS_RULES = {
    "robots policy exceeds 64 KiB": lambda: F.octet_length("policy") > MOST_POLICY,
    "robots capture cannot redirect": lambda: (F.col("redirect_count") != 0) | F.col("redirect_url").isNotNull(),
}


def refusals(rows: DataFrame, rules: dict = RULES) -> list[tuple[str, DataFrame]]:
    """Each rule with the rows that break it."""
    return [(what, rows.where(broken())) for what, broken in rules.items()]


def violation(rules: dict) -> Column:
    """The first rule that a row breaks, or null."""
    out = F
    for what, broken in rules.items():
        out = out.when(broken(), what)
    return out


def _new_keys(known: DataFrame, asked: DataFrame, key: str, number: str) -> DataFrame:
    """The rows of asked (one for each key) that known lacks, numbered after its own by the order of their keys."""
    new = asked.join(known.select(key), key, "left_anti")
    top = known.agg(F.coalesce(F.max(number), F.lit(0)).alias("_top"))
    ordered = numbered(new.withColumn("_key", F.hex(key) if dict(new.dtypes)[key] == "binary" else F.col(key)), "_key", "_i")
    return ordered.crossJoin(F.broadcast(top)).withColumn(number, (F.col("_i") + F.col("_top")).cast("long")).drop("_i", "_top", "_key")


def changes(state: dict[str, DataFrame], crawls: DataFrame, robots: DataFrame, objects: DataFrame, now: int, last_id: int = 0, last_ms: int = 0) -> dict[str, Append | Merge]:
    """What each table gains, by name. objects: blake2b_256 and raw_bytes of the batch's bodies; last_id, last_ms: the largest id and commit time so far, which never runs backwards."""
    spark = crawls.sparkSession
    named = ["seq", "url", "authority", "redirect_url", "redirect_authority", "redirect_count", "cert_digest", "certificate", "cert_verified", "started_ms", "ended_ms", "status_code", "robots_bitfield", "object_digest", "meta"]
    results = crawls.select(F.lit(0).cast("long").alias("kind"), *named).unionByName(robots.select(F.lit(1).cast("long").alias("kind"), *named))
    order = (F.col("kind") * (1 << 62) + F.col("seq")).alias("at")
    _checked(
        *refusals(results),
        *refusals(robots, ROBOTS_RULES),
        ("invalid published object", objects.where("raw_bytes < 0")),
        ("automatic target has no next enqueue time", crawls.where("evaluated AND NOT retire AND targets <> 0 AND next_enqueue_ms IS NULL")),
    )

    # hosts and pages: every address that the batch names
    pair = lambda u, a: F.struct(F.col(u).alias("url"), F.col(a).alias("authority"))
    said = results.select(F.explode(F.array(pair("url", "authority"), pair("redirect_url", "redirect_authority"))).alias("a")).union(crawls.select(F.explode(F.concat(F.coalesce("probes", F.array()), F.coalesce("links", F.array()))).alias("a")))
    addresses = said.select("a.*").where("url IS NOT NULL").groupBy("url").agg(F.min("authority").alias("authority"))
    known_hosts = state["hosts"]
    new_hosts = _new_keys(known_hosts, addresses.select("authority").distinct(), "authority", "host_id").select("host_id", "authority")
    hosts = known_hosts.join(addresses.select("authority").distinct(), "authority", "left_semi").select("host_id", "authority").unionByName(new_hosts)
    placed = addresses.join(hosts, "authority").select("url", "host_id")
    known_pages = state["pages"].join(placed.select("url"), "url", "left_semi").select(state["pages"].columns)
    new_pages = _new_keys(state["pages"], placed, "url", "page_id").select("page_id", "url", "host_id", F.lit(now).cast("long").alias("first_seen_ms"), F.lit(None).cast("long").alias("latest_crawl_result_id"))
    pages = kept(known_pages.withColumn("_new", F.lit(False)).unionByName(new_pages.withColumn("_new", F.lit(True))), "pages")
    page_of = lambda url, out: pages.select(F.col("url").alias(url), F.col("page_id").alias(out))

    # objects and certificates
    bodies = objects.groupBy("blake2b_256").agg(F.min("raw_bytes").alias("raw_bytes"))
    new_objects = _new_keys(state["objects"], bodies, "blake2b_256", "object_id").select("object_id", "blake2b_256", "raw_bytes", F.lit(now).cast("long").alias("created_ms"))
    digests = results.select(F.col("object_digest").alias("blake2b_256")).where("blake2b_256 IS NOT NULL").distinct()
    object_of = state["objects"].join(digests, "blake2b_256", "left_semi").select(new_objects.columns).unionByName(new_objects).select(F.col("blake2b_256").alias("object_digest"), "object_id", "raw_bytes")
    shown = results.where("cert_digest IS NOT NULL").groupBy(F.col("cert_digest").alias("blake2b_256")).agg(F.min("certificate").alias("certificate"), F.max("certificate").alias("_other"), F.max(F.coalesce("cert_verified", F.lit(False))).alias("pkix_verified"))
    known_certs = state["certificates"].join(shown.select("blake2b_256", F.col("certificate").alias("_shown"), F.col("pkix_verified").alias("_ok")), "blake2b_256")
    columns = ["certificate_id", "blake2b_256", "certificate", "pkix_verified"]
    certs = kept(known_certs.withColumn("pkix_verified", F.col("pkix_verified") | F.col("_ok")).select(columns).unionByName(_new_keys(state["certificates"], shown, "blake2b_256", "certificate_id").select(columns)), "certificates")

    # captures
    held = numbered(results.select("*", order), "at", "_k").withColumns({"crawl_result_id": F.col("_k") + last_id, "committed_ms": F.lit(max(now, last_ms)).cast("long")}).drop("_k")
    rows = held.join(page_of("url", "page_id"), "url").join(pages.select("page_id", "host_id"), "page_id").join(page_of("redirect_url", "redirected_to_page_id"), "redirect_url", "left")
    rows = rows.join(certs.select(F.col("blake2b_256").alias("cert_digest"), "certificate_id"), "cert_digest", "left").join(object_of, "object_digest", "left")
    rows = kept(rows, "captures")
    capture = [f.split(" ")[0] for f in TABLES["events"].split(", ")][:-1]
    asked = crawls.join(page_of("url", "page_id"), "url")
    claims = asked.select("page_id", "queue_page_id").join(state["queue"].where("state_code = 1").select("page_id", F.lit(True).alias("_claimed")), "page_id", "left")
    _checked(
        ("certificate digest collision", shown.where("certificate <> _other")),
        ("certificate digest collision", known_certs.where("certificate <> _shown")),
        ("object digest collision", objects.groupBy("blake2b_256").agg(F.min("raw_bytes").alias("a"), F.max("raw_bytes").alias("b")).where("a <> b")),
        ("crawl references an unpublished object", rows.where("object_digest IS NOT NULL AND object_id IS NULL")),
        ("published crawl does not match its queue claim", claims.where(~F.col("page_id").eqNullSafe(F.col("queue_page_id")))),
        ("published crawl lost its queue claim", claims.where("_claimed IS NULL")),
        ("published crawl lost its queue claim", asked.groupBy("page_id").count().where("count > 1")),
    )
    events = kept(catalog.append(state["heads"], rows.select(capture)).select(*capture, "update_bitfield"), "events")
    newest = F.max_by(F.struct(*[c for c in state["heads"].columns if c != "page_id"]), F.struct("committed_ms", "crawl_result_id"))
    heads = events.groupBy("page_id").agg(newest.alias("h")).select("page_id", "h.*").select(state["heads"].columns)
    latest = rows.groupBy("url").agg(F.max("crawl_result_id").alias("_latest"))
    moved = pages.join(latest, "url", "left").where("_new OR _latest IS NOT NULL").withColumn("latest_crawl_result_id", F.coalesce("_latest", "latest_crawl_result_id")).select(state["pages"].columns)

    out: dict[str, Append | Merge] = {
        "hosts": Merge(new_hosts), "pages": Merge(moved), "objects": Merge(new_objects), "certificates": Merge(certs), "events": Append(events, ("committed_ms", "crawl_result_id")), "heads": Merge(heads),
    }
    done = asked.withColumn("done", F.lit(True))
    out["feeds"] = _feeds(state["feeds"], done)
    out["security"] = _security(state["security"], done)
    probes = asked.select("seq", "ended_ms", F.explode("probes").alias("a")).select("seq", "ended_ms", F.col("a.url").alias("url")).join(page_of("url", "page_id"), "url").select("page_id", "seq", "ended_ms")
    out["automatic"], queued = _automatic(state["automatic"], done, probes)
    links = asked.select("seq", F.explode("links").alias("a")).select("seq", F.col("a.url").alias("url")).distinct().join(pages.where("latest_crawl_result_id IS NULL").select("url", "page_id"), "url")
    links = links.join(done.select("page_id", F.col("seq").alias("_done")), "page_id", "left").where("_done IS NULL OR seq < _done")  # what was fetched before the link was found isn't queued
    asks = links.select("page_id", "seq", F.lit(1).alias("step"), F.lit(REASONS["discovered"]).cast("long").alias("reason"), F.lit(now).cast("long").alias("ready_at_ms")).unionByName(
        queued.select("page_id", "seq", F.lit(0).alias("step"), F.lit(REASONS["watched"]).cast("long").alias("reason"), F.col("ended_ms").alias("ready_at_ms"))
    )
    out["queue"] = _queue(state["queue"], done, asks, pages.select("page_id", "host_id"))
    cached = robots.where("cache").join(rows.where("kind = 1").select("seq", "page_id", "crawl_result_id"), "seq").join(hosts, "authority")
    policy = cached.groupBy("host_id").agg(F.max_by(F.struct(F.col("page_id").alias("robots_page_id"), F.col("crawl_result_id").alias("robots_crawl_result_id"), "checked_ms", "expires_ms", F.lit(1).cast("long").alias("parser_version"), F.col("policy").alias("compiled_rules")), "seq").alias("r"))
    out["robots"] = Merge(policy.select("host_id", "r.*"))
    return out


def _feeds(known: DataFrame, done: DataFrame) -> Merge:
    """A judged page that is a feed is kept with its type, else it goes."""
    judged = done.where("retire OR evaluated")
    stays = F.col("evaluated") & ~F.col("retire") & F.col("feed_type").isNotNull()
    rows = judged.where(stays).join(known.select("page_id", "first_recognized_ms"), "page_id", "left")
    return Merge(rows.select("page_id", "feed_type", F.coalesce("first_recognized_ms", "ended_ms").alias("first_recognized_ms"), F.col("ended_ms").alias("last_recognized_ms")), judged.where(~stays).select("page_id"))


def _security(known: DataFrame, done: DataFrame) -> Merge:
    judged = done.where("security_evaluated")
    rows = judged.where("has_security").join(known.select("page_id", "first_seen_ms"), "page_id", "left")
    return Merge(rows.select("page_id", F.coalesce("first_seen_ms", "ended_ms").alias("first_seen_ms"), F.col("ended_ms").alias("last_seen_ms")), judged.where("NOT coalesce(has_security, FALSE)").select("page_id"))


def _automatic(known: DataFrame, done: DataFrame, probes: DataFrame) -> tuple[Merge, DataFrame]:
    """The changes to pages that are fetched again by themselves, and the probes (page_id, seq, ended_ms) that are to be queued: those that made a row.

    A page's own fetch may take its row out or change it; a probe makes one where there is none, before that fetch or after it.
    """
    own = done.select("page_id", F.col("seq").alias("b"), F.col("ended_ms").alias("_ended"), (F.col("retire") | (F.col("evaluated") & (F.col("targets") == 0))).alias("_out"), (F.col("evaluated") & ~F.col("retire") & (F.col("targets") != 0)).alias("_in"), "targets", F.col("next_enqueue_ms").alias("_next"))
    first = lambda when: F.min(F.when(when, F.struct("seq", "ended_ms")))
    early = F.col("b").isNull() | (F.col("seq") < F.col("b"))
    by = probes.join(own.select("page_id", "b"), "page_id", "left").groupBy("page_id").agg(first(early).alias("p"), first(~early).alias("q"))
    rows = by.join(own, "page_id", "full").join(known, "page_id", "left").withColumns({"_out": F.coalesce("_out", F.lit(False)), "_in": F.coalesce("_in", F.lit(False))})
    was = F.col("target_bitfield").isNotNull()
    made = F.when(~was, F.col("p"))  # by a probe before the fetch
    there = F.when(F.col("_out"), F.lit(False)).when(F.col("_in"), F.lit(True)).otherwise(was | made.isNotNull())
    again = F.when(~there, F.col("q"))  # by a probe after it
    bit = F.lit(TARGETS["security"]).cast("long")
    fresh = lambda s: F.struct(bit.alias("t"), s["ended_ms"].alias("f"), s["ended_ms"].alias("l"), s["ended_ms"].alias("n"))
    before = F.when(was, F.struct(F.col("target_bitfield").alias("t"), F.col("first_recognized_ms").alias("f"), F.col("last_recognized_ms").alias("l"), F.col("next_enqueue_ms").alias("n"))).when(made.isNotNull(), fresh(made))
    judged = F.struct(F.col("targets").cast("long").alias("t"), F.coalesce(before["f"], F.col("_ended")).alias("f"), F.col("_ended").alias("l"), F.coalesce(before["n"], F.col("_next")).alias("n"))
    final = F.when(again.isNotNull(), fresh(again)).when(F.col("_out"), F.lit(None)).when(F.col("_in"), judged).otherwise(before)
    rows = kept(rows.select("page_id", final.alias("r"), F.filter(F.array(made, again), lambda x: x.isNotNull()).alias("new")), "automatic")
    put = rows.where("r IS NOT NULL").select("page_id", F.col("r.t").alias("target_bitfield"), F.col("r.f").alias("first_recognized_ms"), F.col("r.l").alias("last_recognized_ms"), F.col("r.n").alias("next_enqueue_ms"))
    return Merge(put, rows.where("r IS NULL").select("page_id")), rows.select("page_id", F.explode("new").alias("x")).select("page_id", "x.seq", "x.ended_ms")


def _queue(known: DataFrame, done: DataFrame, asks: DataFrame, hosts: DataFrame) -> Merge:
    """The queue's changes: asks (page_id, seq, step, reason, ready_at_ms) join a row's reason, and make one where there is none; a fetch then ends its claim or puts it back."""
    ends = done.select("page_id", F.col("seq").alias("b"), "retry_ms")
    rows = asks.join(ends.select("page_id", "b"), "page_id", "left")
    early = F.col("b").isNull() | (F.col("seq") <= F.col("b"))
    asked = lambda when: [F.bit_or(F.when(when, F.col("reason"))), F.min_by(F.when(when, F.col("ready_at_ms")), F.when(when, F.struct("seq", "step")))]
    (r1, t1), (r2, t2) = asked(early), asked(~early)
    by = rows.groupBy("page_id").agg(r1.alias("_r1"), t1.alias("_t1"), r2.alias("_r2"), t2.alias("_t2"))
    both = by.join(ends, "page_id", "full").join(known.select("page_id", "state_code", F.col("reason").alias("_r0"), F.col("ready_at_ms").alias("_t0")), "page_id", "left").join(hosts, "page_id")
    zero = F.lit(0).cast("long")
    reason = F.coalesce("_r0", zero).bitwiseOR(F.coalesce("_r1", zero))
    late = F.coalesce("_r2", zero)
    ended, back = F.col("b").isNotNull(), F.col("retry_ms").isNotNull()
    row = F.when(~ended, F.struct(F.coalesce("state_code", zero).alias("s"), reason.alias("r"), F.coalesce("_t0", "_t1").alias("t")))
    row = row.when(back, F.struct(zero.alias("s"), reason.bitwiseOR(F.lit(REASONS["retry"])).bitwiseOR(late).alias("r"), F.col("retry_ms").alias("t"))).when(F.col("_r2").isNotNull(), F.struct(zero.alias("s"), late.alias("r"), F.col("_t2").alias("t")))
    out = kept(both.select("page_id", "host_id", row.alias("x")), "queue")
    return Merge(out.where("x IS NOT NULL").select("page_id", "host_id", F.col("x.s").cast("long").alias("state_code"), F.col("x.r").cast("long").alias("reason"), F.col("x.t").alias("ready_at_ms")), out.where("x IS NULL").select("page_id"))


def applied(state: dict[str, DataFrame], made: dict[str, Append | Merge]) -> dict[str, DataFrame]:
    """The tables after the changes."""
    out = dict(state)
    for name, c in made.items():
        if isinstance(c, Append):
            out[name] = state[name].unionByName(c.rows.select(state[name].columns))
            continue
        gone = c.rows.select(KEYS[name]) if c.gone is None else c.rows.select(KEYS[name]).union(c.gone.select(KEYS[name]))
        out[name] = state[name].join(gone, KEYS[name], "left_anti").select(state[name].columns).unionByName(c.rows.select(state[name].columns))
    return out


def publish(store: Store, crawls: DataFrame, robots: DataFrame, objects: DataFrame, now: int, writer: str | None = None, batch: int | None = None) -> int:
    """Commits a batch to a store's tables as one version: all of it, once, or nothing. A store without tables gets them.

    Events are kept twice: in commit order, for feeds, and in buckets by page (captures), for a page's history.
    """
    old = store.manifest()
    if batch is not None and batch <= old["writers"].get(writer, -1):
        return old["version"]
    state = empty_state(store.spark) | {t: store.read(t, manifest=old) for t in old["tables"] if t in TABLES}
    last_id, last_ms = old["facts"].get("crawl_result_id", 0), old["facts"].get("committed_ms", 0)
    with scratch(store.spark):
        made = changes(state, crawls, robots, objects, now, last_id, last_ms)
        made["captures"] = Append(made["events"].rows, ("page_id", "committed_ms", "crawl_result_id"), "page_id")
        facts = {"crawl_result_id": last_id + made["events"].rows.count(), "committed_ms": max(now, last_ms)}
        return store.commit(made, writer, batch, facts, old["version"])


def open_store(spark: SparkSession, place: str, buckets: int = 64) -> Store:
    """The archive's tables at a place, made where there are none; claims that a writer left are free again."""
    from . import frontier

    store = Store(spark, place, KEYS, buckets, BLOOMS)
    m = store.manifest()
    if not m["tables"]:
        empty = empty_state(spark)
        store.commit({name: Merge(rows) if name in KEYS else Append(rows) for name, rows in empty.items()} | {"captures": Append(empty["events"], ("page_id",), "page_id")}, base=0)
    elif (left := store.read("queue", manifest=m).where("state_code = 1")).head(1):
        store.commit({"queue": Merge(frontier.recover(left))}, base=m["version"])
    return store
