"""Batches as one commit, against the same rules applied row by row in plain Python."""

import os
import random

import pytest

from palimpsest.operators import publish as P
from palimpsest.session import shared_place
from palimpsest.sources.store import Store

SITES = [f"h{i}.test:1965" for i in range(4)]


def address(url):
    return (url, f"{url.split('/')[2]}:1965")


class Plain:
    """The archive as dictionaries; ids of pages, hosts, objects and certificates are left out, as their numbers are free."""

    def __init__(self):
        self.hosts, self.pages, self.certs, self.objects = set(), {}, {}, {}
        self.events, self.queue, self.automatic, self.feeds, self.security, self.robots = [], {}, {}, {}, {}, {}
        self.ms = 0

    def page(self, url, now):
        self.hosts.add(address(url)[1])
        self.pages.setdefault(url, [now, None])
        return url

    def capture(self, r, now):
        url = self.page(r["url"], now)
        if r["redirect_url"]:
            self.page(r["redirect_url"], now)
        if r["cert_digest"]:
            self.certs[r["cert_digest"]] = self.certs.get(r["cert_digest"], False) or r["cert_verified"]
        before = [e for e in self.events if e["url"] == url]
        old, bits = (before[-1], before[-1]["robots_bitfield"]) if before else (None, 0)
        same = old and all(old[c] == r[c] for c in ("status_code", "redirect_url", "redirect_count", "object_digest", "meta"))
        new = r["robots_bitfield"]
        self.events.append(r | {"committed_ms": max(now, self.ms), "id": len(self.events) + 1, "update_bitfield": ((new ^ bits) | (0 if same else new & bits)) & 31})
        self.pages[url][1] = len(self.events)
        return url, len(self.events)

    def batch(self, crawls, robots, objects, now):
        for d, n in objects:
            self.objects.setdefault(d, n)
        for r in sorted(crawls, key=lambda r: r["seq"]):
            url, _ = self.capture(r, now)
            at = r["ended_ms"]
            if r["retire"]:
                self.automatic.pop(url, None)
                self.feeds.pop(url, None)
            elif r["evaluated"]:
                if not r["targets"]:
                    self.automatic.pop(url, None)
                else:
                    row = self.automatic.setdefault(url, [0, at, at, r["next_enqueue_ms"]])
                    row[0], row[2] = r["targets"], at
                if r["feed_type"]:
                    row = self.feeds.setdefault(url, ["", at, at])
                    row[0], row[2] = r["feed_type"], at
                else:
                    self.feeds.pop(url, None)
            if r["security_evaluated"]:
                if r["has_security"]:
                    self.security.setdefault(url, [at, at])[1] = at
                else:
                    self.security.pop(url, None)
            for u, _ in r["probes"] or ():
                self.page(u, now)
                if u not in self.automatic:
                    self.automatic[u] = [8, at, at, at]
                    self.queue.setdefault(u, [0, 0, at])[1] |= 4
            for u, _ in r["links"] or ():
                self.page(u, now)
                if self.pages[u][1] is None:
                    self.queue.setdefault(u, [0, 0, now])[1] |= 1
            state = self.queue.pop(url)
            assert state[0] == 1
            if r["retry_ms"] is not None:
                self.queue[url] = [0, state[1] | 8, r["retry_ms"]]
        for r in sorted(robots, key=lambda r: r["seq"]):
            url, i = self.capture(r, now)
            if r["cache"]:
                self.robots[r["authority"]] = (url, i, r["checked_ms"], r["expires_ms"], r["policy"])
        self.ms = max(now, self.ms)

    def tables(self):
        return {
            "hosts": self.hosts,
            "pages": {u: tuple(v) for u, v in self.pages.items()},
            "certificates": self.certs,
            "objects": self.objects,
            "events": [(e["id"], e["url"], e["redirect_url"], e["committed_ms"], e["status_code"], e["cert_digest"], e["object_digest"], e["update_bitfield"]) for e in self.events],
            "queue": {u: (address(u)[1], *v) for u, v in self.queue.items()},
            "automatic": {u: tuple(v) for u, v in self.automatic.items()},
            "feeds": {u: tuple(v) for u, v in self.feeds.items()},
            "security": {u: tuple(v) for u, v in self.security.items()},
            "robots": self.robots,
        }


def told(state):
    """The same of the engine's tables."""
    t = {k: df.collect() for k, df in state.items()}
    url, host = {r.page_id: r.url for r in t["pages"]}, {r.host_id: r.authority for r in t["hosts"]}
    assert len(url) == len(t["pages"]) and len(host) == len(t["hosts"]) and len({r.url for r in t["pages"]}) == len(url)
    assert all(host[r.host_id] == address(r.url)[1] for r in t["pages"])
    cert, body = {r.certificate_id: bytes(r.blake2b_256) for r in t["certificates"]}, {r.object_id: bytes(r.blake2b_256) for r in t["objects"]}
    heads = {url[r.page_id]: r.crawl_result_id for r in t["heads"]}
    assert heads == {r.url: r.latest_crawl_result_id for r in t["pages"] if r.latest_crawl_result_id is not None}
    return {
        "hosts": set(host.values()),
        "pages": {r.url: (r.first_seen_ms, r.latest_crawl_result_id) for r in t["pages"]},
        "certificates": {bytes(r.blake2b_256): r.pkix_verified for r in t["certificates"]},
        "objects": {bytes(r.blake2b_256): r.raw_bytes for r in t["objects"]},
        "events": sorted((r.crawl_result_id, url[r.page_id], url.get(r.redirected_to_page_id), r.committed_ms, r.status_code, cert.get(r.certificate_id), body.get(r.object_id), r.update_bitfield) for r in t["events"]),
        "queue": {url[r.page_id]: (host[r.host_id], r.state_code, r.reason, r.ready_at_ms) for r in t["queue"]},
        "automatic": {url[r.page_id]: tuple(r)[1:] for r in t["automatic"]},
        "feeds": {url[r.page_id]: tuple(r)[1:] for r in t["feeds"]},
        "security": {url[r.page_id]: tuple(r)[1:] for r in t["security"]},
        "robots": {host[r.host_id]: (url[r.robots_page_id], r.robots_crawl_result_id, r.checked_ms, r.expires_ms, r.compiled_rules) for r in t["robots"]},
    }


def result(rng, seq, url, now, **more):
    status = rng.choice([20, 20, 31, 51, None])
    to = f"gemini://h{rng.randrange(6)}.test/{rng.randrange(8)}" if status == 31 else None
    cert = rng.choice([None, b"c1", b"c2", b"c3"])
    return {
        "seq": seq, "url": url, "authority": address(url)[1], "redirect_url": to, "redirect_authority": to and address(to)[1], "redirect_count": int(to is not None), "cert_digest": cert, "certificate": cert and cert * 3, "cert_verified": bool(cert) and rng.random() < 0.4,
        "started_ms": now - 50, "ended_ms": now - rng.randrange(50), "status_code": status, "robots_bitfield": rng.randrange(32), "object_digest": rng.choice([b"o1", b"o2"]) if status == 20 else None, "meta": rng.choice(["text/gemini", "x"]), **more,
    }


def a_batch(rng, plain, page_ids, now):
    """Fetches of all claims, and robots captures, over few pages, so that rows of a batch meet each other."""
    claimed = [u for u, q in plain.queue.items() if q[0] == 1]
    rng.shuffle(claimed)
    some = lambda n: [address(f"gemini://h{rng.randrange(6)}.test/{rng.randrange(8)}") for _ in range(rng.randrange(n))] or None
    probe = lambda: [address(f"gemini://h{rng.randrange(6)}.test/{rng.choice(['s', '0', '1'])}") for _ in range(rng.randrange(4))] or None
    crawls = [
        result(
            rng, seq, u, now, queue_page_id=page_ids[u], retire=rng.random() < 0.1, evaluated=rng.random() < 0.8, targets=rng.choice([0, 1, 2, 8]), next_enqueue_ms=now + 1000 + seq, feed_type=rng.choice([None, "atom", "rss"]),
            security_evaluated=rng.random() < 0.5, has_security=rng.random() < 0.5, probes=probe(), links=some(6), retry_ms=rng.choice([None, now + 77]),
        )
        for seq, u in enumerate(claimed)
    ]
    robots = [result(rng, k, f"gemini://{h}/robots.txt".replace(":1965", ""), now, policy="User-agent: *", cache=rng.random() < 0.7, checked_ms=now, expires_ms=now + 9) for k, h in enumerate(rng.sample(SITES, 2))]
    for r in robots:
        r.update(redirect_url=None, redirect_authority=None, redirect_count=0, status_code=20)
    return crawls, robots, [(b"o1", 11), (b"o2", 22)]


def frames(spark, batch):
    crawls, robots, objects = batch
    rows = lambda data, schema: spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in _columns(schema)) for r in data], schema)
    return rows(crawls, P.CRAWLS), rows(robots, P.ROBOTS), spark.createDataFrame(objects, "blake2b_256 binary, raw_bytes long")


def _columns(schema):
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def claim_all(store, plain, rng):
    """Claims some of the queue's pages in both."""
    q, pages = store.read("queue").collect(), {r.page_id: r.url for r in store.read("pages").collect()}
    some = {r.page_id for r in q if rng.random() < 0.7}
    df = store.spark.createDataFrame([(r.page_id, r.host_id, int(r.page_id in some), r.reason, r.ready_at_ms) for r in q], P.TABLES["queue"])
    store.commit({"queue": P.Merge(df)})
    for i in some:
        plain.queue[pages[i]][0] = 1
    return {u: i for i, u in pages.items()}


@pytest.fixture
def seeded(spark, tmp_path):
    """A store with pages that are queued, and the same in plain Python."""
    store, plain = P.open_store(spark, f"file://{tmp_path}/a", 4), Plain()
    urls = [f"gemini://h{i % 4}.test/{i}" for i in range(8)]
    hosts = {h: k + 1 for k, h in enumerate(SITES)}
    store.commit({
        "hosts": P.Merge(spark.createDataFrame([(i, h) for h, i in hosts.items()], P.TABLES["hosts"])),
        "pages": P.Merge(spark.createDataFrame([(i + 1, u, hosts[address(u)[1]], 5, None) for i, u in enumerate(urls)], P.TABLES["pages"])),
        "queue": P.Merge(spark.createDataFrame([(i + 1, hosts[address(u)[1]], 0, 2, 9) for i, u in enumerate(urls)], P.TABLES["queue"])),
        "automatic": P.Merge(spark.createDataFrame([(1, 1, 3, 3, 44), (2, 8, 3, 3, 44)], P.TABLES["automatic"])),
    })
    plain.hosts |= set(SITES)
    plain.pages = {u: [5, None] for u in urls}
    plain.queue = {u: [0, 2, 9] for u in urls}
    plain.automatic = {urls[0]: [1, 3, 3, 44], urls[1]: [8, 3, 3, 44]}
    return store, plain


def test_against_one_by_one(spark, seeded):
    store, plain = seeded
    rng = random.Random(1)
    for number, now in enumerate((1000, 500)):  # the clock may run backwards, commits don't
        batch = a_batch(rng, plain, claim_all(store, plain, rng), now)
        plain.batch(*batch, now)
        before = store.manifest()["version"]
        assert P.publish(store, *frames(spark, batch), now, "crawler", number) == before + 1
        assert P.publish(store, *frames(spark, batch), now, "crawler", number) == before + 1, "a batch that was committed is not committed again"
        got, want = told(store.state()), plain.tables()
        for name in want:
            assert got[name] == want[name], name
    assert plain.queue and plain.automatic and plain.robots and len(plain.events) > 6


def test_refusals_change_nothing(spark, seeded):
    store, plain = seeded
    rng = random.Random(4)
    ids = claim_all(store, plain, rng)
    before, version = told(store.state()), store.manifest()["version"]
    good = a_batch(rng, plain, ids, 1000)
    free = next(u for u in ids if plain.queue[u][0] == 0)

    def with_(kind, **change):
        crawls, robots, objects = ([dict(r) for r in good[0]], [dict(r) for r in good[1]], list(good[2]))
        {"crawl": crawls, "robots": robots}[kind][0].update(change)
        return crawls, robots, objects

    cases = [
        (with_("crawl", authority=""), "requires a page URL"),
        (with_("crawl", object_digest=b"nowhere"), "unpublished object"),
        (with_("crawl", queue_page_id=-5), "does not match"),
        (with_("crawl", url=free, authority=address(free)[1], queue_page_id=ids[free]), "lost its queue claim"),
        (with_("crawl", evaluated=True, retire=False, targets=1, next_enqueue_ms=None), "next enqueue time"),
        (with_("robots", policy="x" * 65_537), "64 KiB"),
        ((good[0], good[1], [(b"o1", 11), (b"o1", 12), (b"o2", 22)]), "collision"),
    ]
    for batch, what in cases:
        with pytest.raises(P.Refused, match=what):
            P.publish(store, *frames(spark, batch), 1000, "crawler", 0)
    assert store.manifest()["version"] == version and told(store.state()) == before


def test_single_rules(spark):
    """What a capture must keep by itself, without a store."""
    rows = [result(random.Random(k), k, "gemini://h/", 100) | change for k, change in enumerate([{}, {"authority": ""}, {"redirect_url": "gemini://x/", "redirect_authority": ""}, {"redirect_count": -1}, {"started_ms": 9999}, {"robots_bitfield": 32}, {"meta": "é" * 513}])]
    schema = P._RESULT
    df = spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in _columns(schema)) for r in rows], schema)
    assert {r.seq: r.why for r in df.withColumn("why", P.violation(P.RULES)).collect()} == dict(enumerate([None, *P.RULES]))
    assert [sorted(r.seq for r in bad.collect()) for _, bad in P.refusals(df)] == [[1], [2], [3], [4], [5], [6]]


def test_empty_batch_and_recovery(spark, tmp_path):
    place = f"file://{tmp_path}/b"
    store = P.open_store(spark, place, 2)
    empty = frames(spark, ([], [], []))
    shared = f"{shared_place(spark).removeprefix('file://')}/palimpsest"
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    assert P.publish(store, *empty, 5, "w", 0) == 2 and all(df.count() == 0 for df in store.state().values())
    own = ("numbered-", "pages-", "certificates-", "captures-", "automatic-", "queue-")
    assert {f for f in os.listdir(shared) if f.startswith(own)} <= before, "a batch leaves no scratch"
    store.commit({"queue": P.Merge(spark.createDataFrame([(1, 1, 1, 4, 7), (2, 1, 0, 4, 7)], P.TABLES["queue"]))})
    assert sorted(map(tuple, P.open_store(spark, place, 2).read("queue").collect())) == [(1, 1, 0, 4, 7), (2, 1, 0, 4, 7)]
    assert isinstance(Store(spark, place, P.KEYS).manifest()["facts"], dict)


def test_stream_of_batches(spark, seeded, tmp_path):
    """Micro-batches are published one by one, each once, also when the query starts anew without knowing what it had done."""
    from palimpsest.streaming.publishing import publish_stream

    store, plain = seeded
    ids = claim_all(store, plain, random.Random(5))
    urls = sorted(u for u, q in plain.queue.items() if q[0] == 1)[:2]
    version = store.manifest()["version"]

    def prepare(df):
        rows = [result(random.Random(k), k, u, 1000, queue_page_id=ids[u], retire=False, evaluated=False, targets=0, next_enqueue_ms=None, feed_type=None, security_evaluated=False, has_security=False, probes=None, links=None, retry_ms=None) for k, u in enumerate(r.url for r in df.orderBy("url").collect())]
        return *frames(spark, (rows, [], [(b"o1", 11), (b"o2", 22)])), 1000

    spark.createDataFrame([(u,) for u in urls], "url string").coalesce(1).write.parquet(str(tmp_path / "in"))
    for cp in ("cp", "cp2"):
        stream = spark.readStream.schema("url string").parquet(str(tmp_path / "in"))
        publish_stream(stream, store, str(tmp_path / cp), prepare).awaitTermination()
        assert store.manifest()["version"] == version + 1 and store.read("events").count() == store.read("captures").count() == 2
