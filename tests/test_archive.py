"""Two pages of a small archive: one that is hidden for a while and moves, one that stays as it is."""

import pytest

from palimpsest.operators import catalog, certificates, feed, frontier, graph, history

COLS = "crawl_result_id long, page_id long, host_id long, redirected_to_page_id long, redirect_count long, certificate_id long, started_ms long, ended_ms long, committed_ms long, status_code long, robots_bitfield long, object_id long, raw_bytes long, meta string"
ROWS = [
    (11, 5, 2, None, 0, 7, 100, 140, 200, 20, 6, 31, 500, "text/plain"),
    (12, 6, 2, None, 0, 7, 210, 220, 300, 20, 4, 32, 90, "image/png"),
    (13, 5, 2, None, 0, 7, 320, 330, 400, 20, 2, 31, 500, "text/plain"),
    (14, 5, 2, 6, 1, 7, 410, 430, 500, 31, 6, None, None, "/6"),
    (15, 6, 2, None, 0, 7, 510, 520, 600, 20, 4, 32, 90, "image/png"),
]


@pytest.fixture(scope="module")
def captures(spark):
    return spark.createDataFrame(ROWS, COLS).cache()


@pytest.fixture(scope="module")
def events(captures):
    return history.with_events(captures).cache()


def ids(df):
    return [r.crawl_result_id for r in df.collect()]


def test_events(events):
    """A page that archivers may not see is news to them alone; what stays as it is is no news."""
    assert {r.crawl_result_id: r.update_bitfield for r in events.collect()} == {11: 6, 12: 4, 13: 4, 14: 6, 15: 0}


@pytest.mark.parametrize("cut", [0, 250, 450, 550])
def test_appending_equals_rebuilding(captures, events, cut):
    old, new = captures.where(f"committed_ms <= {cut}"), captures.where(f"committed_ms > {cut}")
    got = {r.crawl_result_id: r.update_bitfield for r in catalog.append(catalog.heads(old), new).collect()}
    assert got == {r.crawl_result_id: r.update_bitfield for r in events.where(f"committed_ms > {cut}").collect()}


def test_late_captures(spark, captures, events):
    """A capture that is dated back is compared with its true predecessor; without the table it is refused, and none of the rows after it changes."""
    late = spark.createDataFrame([(21, 5, 2, None, 0, 7, 440, 445, 450, 20, 2, 31, 500, "text/plain"), (22, 5, 2, None, 0, 7, 90, 95, 100, 20, 4, 31, 500, "text/plain"), (23, 5, 2, 6, 1, 7, 910, 930, 950, 31, 6, None, None, "/6"), (24, 7, 2, None, 0, 7, 1, 2, 3, 20, 1, 31, 500, "x")], COLS)
    got = {r.crawl_result_id: r.update_bitfield for r in catalog.append(catalog.heads(captures), late, events).collect()}
    assert got == {21: 0, 22: 4, 23: 0, 24: 1}
    with pytest.raises(Exception, match="late capture"):
        catalog.append(catalog.heads(captures), late.where("crawl_result_id = 21")).collect()
    assert catalog.append(catalog.heads(captures), late.limit(0), events).count() == 0


@pytest.mark.parametrize("hot", [100, 7])
def test_hot_keys(spark, monkeypatch, hot):
    """A page (and host) with half of all captures: its order is cut in slices, no slice has more than twice its share, and every result is that of a plain window."""
    import random

    rng = random.Random(3)
    rows = []
    for i in range(1200):
        page = 1 if i % 2 else rng.randrange(2, 60)
        t = rng.randrange(3000)
        rows.append((i, page, 1 if page == 1 else page % 9, rng.choice([None, 3, 4]), rng.randrange(2), rng.choice([None, 1, 2]), t, t + 5, t + rng.randrange(40), rng.choice([20, 31]), rng.randrange(8), rng.choice([None, 5]), 10, rng.choice(["a", "b"])))
    df = spark.createDataFrame(rows, COLS).repartition(5)
    certs = spark.createDataFrame([(1, "a", False), (2, "b", True)], "certificate_id long, fp string, pkix_verified boolean")
    results = {
        "events": lambda: history.with_events(df),
        "timeline": lambda: history.timeline(df, 6).select("crawl_result_id"),
        "neighbours": lambda: history.with_neighbors(df, 4).select("crawl_result_id", "previous_id", "next_id"),
        "certificates": lambda: certificates.changes(df, certs),
        "late": lambda: catalog.append(catalog.heads(history.with_events(df.where("crawl_result_id % 3 > 0"))), df.where("crawl_result_id % 3 = 0"), history.with_events(df.where("crawl_result_id % 3 > 0"))),
    }
    plain = {k: sorted(map(str, f().collect())) for k, f in results.items()}
    monkeypatch.setattr(history, "HOT_ROWS", hot)
    seen, keep = [], history.kept
    monkeypatch.setattr(history, "kept", lambda d, name: seen.append(keep(d, name)) or seen[-1])
    for k, f in results.items():
        seen.clear()
        assert sorted(map(str, f().collect())) == plain[k], k
        sizes = [r["count"] for s in seen for r in s.groupBy("page_id" if "page_id" in s.columns else "host_id", "_slice").count().collect()]
        assert seen and max(sizes) <= max(2 * hot / 4, 8), (k, max(sizes))


def test_doubling_joins(spark, captures):
    """Sixteen hops take the joins of four doublings, and long walks are whole: 40 pages in a row, a circle, a dead end."""
    rows = [(i, i, 1, i + 1, 1, None, i, i, i, 31, 4, None, None, "/") for i in range(1, 40)] + [(40, 40, 1, None, 0, None, 40, 40, 40, 20, 4, 1, 1, "x")]
    rows += [(50 + i, 50 + i, 1, 50 + (i + 1) % 3, 1, None, 1, 1, 50 + i, 30, 4, None, None, "/") for i in range(3)] + [(60, 60, 1, 99, 1, None, 1, 1, 60, 31, 4, None, None, "/")]
    df = spark.createDataFrame(rows, COLS)
    roots = spark.createDataFrame([(k, k) for k in (1, 30, 40, 50, 60, 99)], "root long, page_id long")
    for hops in (1, 2, 5, 16, 64):
        by = {}
        for r in graph.chains(df, roots, 4, 100, hops).orderBy("root", "depth").collect():
            by.setdefault(r.root, []).append(r.page_id)
        assert by == {1: list(range(1, 41))[:hops], 30: list(range(30, 41))[:hops], 40: [40], 50: [50 + i % 3 for i in range(hops)], 60: [60]}
    calls, double = [], graph.doubled
    graph.doubled = lambda w: calls.append(1) or double(w)
    try:
        graph.chains(df, roots, 4, 100)
    finally:
        graph.doubled = double
    assert len(calls) == 4


def test_append_refuses(captures):
    with pytest.raises(Exception, match="ended_before_started"):
        catalog.append(catalog.heads(captures), captures.where("crawl_result_id = 15").selectExpr(*[c if c != "ended_ms" else "1 AS ended_ms" for c in captures.columns])).collect()


def test_events_by_range(spark, events, tmp_path):
    catalog.write_events(events, str(tmp_path / "ev"))
    rows = feed.feed(spark.read.parquet(str(tmp_path / "ev")), 4, (300, 12))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "GreaterThan" in plan.split("PushedFilters")[1] and sorted(ids(rows)) == [13, 14]


def test_statistics(captures):
    assert tuple(history.statistics(captures).first()) == (2, 680, 1, 2)


def test_history(captures):
    assert ids(history.archive(captures, 5, 2)) == [14, 13, 11]
    assert ids(history.archive(captures, 5, 2, (410, 14), 1)) == [13]
    assert ids(history.archive(captures, 5, 4, (0, 0))) == [14, 11]


@pytest.mark.parametrize(("use", "at", "want"), [(4, None, [14, 15]), (4, 450, [11, 12]), (2, 450, [13]), (4, 199, []), (8, None, [])])
def test_as_of(captures, use, at, want):
    assert sorted(ids(history.as_of(captures, use, at))) == want


@pytest.mark.parametrize(
    ("use", "after", "through", "extra", "want"),
    [
        (4, (200, 11), 500, {}, [(12, False), (13, True), (14, False)]),
        (4, (0, 0), 499, {}, [(11, False), (12, False), (13, True)]),
        (2, (0, 0), 600, {}, [(11, False), (14, False)]),
        (4, (0, 0), 600, {"mimes": ["image/*"]}, [(12, False), (13, True), (14, False)]),
        (4, (0, 0), 600, {"max_bytes": 100}, [(12, False), (13, True), (14, False)]),
    ],
)
def test_feed(events, use, after, through, extra, want):
    rows = feed.page(feed.feed(events, use, after, through, **extra)).orderBy("position").collect()
    assert [(r.crawl_result_id, r.removal) for r in rows] == want


def test_pages_are_the_feed(events):
    whole = [r.crawl_result_id for r in feed.page(feed.feed(events, 4)).orderBy("position").collect()]
    got, cursor = [], (0, 0)
    while True:
        rows = feed.page(feed.feed(events, 4, cursor), 1).collect()
        if not rows:
            break
        got.append(rows[0].crawl_result_id)
        cursor = (rows[0].committed_ms, rows[0].crawl_result_id)
    assert got == whole


def test_chains(spark, captures):
    roots = spark.createDataFrame([(1, 5), (2, 6), (3, 99)], "root long, page_id long")
    walked = lambda at: sorted((r.root, r.depth, r.crawl_result_id) for r in graph.chains(captures, roots, 4, at).collect())
    assert walked(600) == [(1, 0, 14), (1, 1, 15), (2, 0, 15)] and walked(350) == [(1, 0, 11), (2, 0, 12)]
    circle = captures.union(spark.createDataFrame([(16, 6, 2, 5, 1, 7, 610, 620, 700, 30, 4, None, None, "/5")], COLS))
    assert sorted(r.depth for r in graph.chains(circle, roots.where("root = 1"), 4, 700, hops=5).collect()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize(
    ("hops", "want"),
    [
        ([], ("unresolved_target", "unknown", 1)),
        ([(2, 20, None)], ("complete", "permanent", 2)),
        ([(2, 30, 3), (3, 20, None)], ("complete", "temporary", 3)),
        ([(2, 31, 1), (1, 31, 2)], ("cycle", "unknown", 2)),
        ([(i, 31, i + 1) for i in range(2, 30)], ("depth_limit", "unknown", 17)),
    ],
)
def test_verdict(spark, hops, want):
    roots = spark.createDataFrame([(9, 1, 2, 31)], "root long, origin long, page_id long, status_code long")
    walk = spark.createDataFrame([(9, d, p, s, n) for d, (p, s, n) in enumerate(hops)], "root long, depth long, page_id long, status_code long, next_page long")
    r = graph.verdicts(roots, walk).first()
    assert (r.resolution, r.verdict) == want[:2] and r.n_hops in (want[2], want[2] - 1)


def test_certificates(spark, captures):
    more = captures.union(spark.createDataFrame([(16, 6, 2, None, 0, 8, 700, 707, 720, 20, 4, 33, 10, "image/png"), (17, 5, 2, None, 0, None, 730, 740, 750, 51, 4, None, None, "gone")], COLS))
    certs = lambda ok: spark.createDataFrame([(7, "a", ok), (8, "b", ok)], "certificate_id long, fp string, pkix_verified boolean")
    r = certificates.changes(more, certs(False)).collect()
    assert [(x.host_id, x.previous_crawl_result_id, x.previous_certificate_id, x.certificate_id, x.observed_ms) for x in r] == [(2, 15, 7, 8, 707)]
    assert certificates.changes(more, certs(True)).count() == 0 and certificates.changes(more, certs(True), alerts=False).count() == 1
    assert certificates.state(more).first().certificate_id == 8


def test_outcome_cuts_bytes(spark):
    rows = spark.createDataFrame([(1, 20, None, 1, "é" * 600), (2, 20, None, 1, "a" + "é" * 600), (3, 51, None, None, "a" * 1024)], "crawl_result_id long, status_code long, redirected_to_page_id long, object_id long, meta string")
    got = {r.crawl_result_id: r.meta for r in history.outcome(rows).collect()}
    assert got == {1: "é" * 512, 2: "a" + "é" * 511, 3: "a" * 1024}


def test_lost_claims(spark):
    queue = spark.createDataFrame([(1, 1, 4, 50, 0)], "page_id long, host_id long, reason long, ready_at_ms long, state_code long")
    with pytest.raises(Exception, match="lost claim"):
        frontier.complete(queue, spark.createDataFrame([(1, None)], "page_id long, retry_ms long")).collect()


def test_running_maximum(spark):
    rows = spark.createDataFrame([(i, (i * 37) % 11 + i // 5) for i in range(50)], "i long, v long")
    got = [r.m for r in history.running_max(rows, "i", "v", "m", slice_rows=7).orderBy("i").collect()]
    assert got == [max((k * 37) % 11 + k // 5 for k in range(i + 1)) for i in range(50)]


def test_numbers_by_ranges(spark):
    got = frontier.numbered(spark.range(1000).selectExpr("concat('u', id * 7919 % 1000) AS u"), "u", "n").orderBy("u").collect()
    assert [r.n for r in got] == list(range(1, 1001))


def test_queue(spark):
    queue = spark.createDataFrame([(1, 1, 4, 2000, 0), (2, 1, 1, 3000, 1)], "page_id long, host_id long, reason long, ready_at_ms long, state_code long")
    asked = spark.createDataFrame([(1, 1, 2, 1500), (2, 1, 8, 100), (3, 2, 1, 50)], "page_id long, host_id long, reason long, ready_at_ms long")
    got = {r.page_id: (r.reason, r.ready_at_ms, r.state_code) for r in frontier.merge_into(queue, asked).collect()}
    assert got == {1: (6, 1500, 0), 2: (9, 3000, 1), 3: (1, 50, 0)}
    assert frontier.decide(2000, 1000, 100) == 3100
    with pytest.raises(ValueError):
        frontier.decide(0, 0, 1)


def test_schedule_compare_and_set(spark):
    sched = spark.createDataFrame([(1, 0, 2000)], "page_id long, automatic long, next_enqueue_ms long")
    want = spark.createDataFrame([(1, 0, 2000, 3100)], "page_id long, automatic long, expected_ms long, next_ms long")
    once = frontier.apply_decision(sched, want).collect()[0]
    assert (once.next_enqueue_ms, once.applied) == (3100, True)
    again = frontier.apply_decision(spark.createDataFrame([(1, 0, 3100)], "page_id long, automatic long, next_enqueue_ms long"), want).collect()[0]
    assert (again.next_enqueue_ms, again.applied) == (3100, False)


def test_plans_push_down(spark, sf):
    from palimpsest.plans import queries as plans

    plan = plans.retrieve_asof(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "props" in plan and "value" not in plan.split("ReadSchema")[1]


def test_empty(spark):
    none = spark.createDataFrame([], COLS)
    assert history.with_events(none).count() == 0 and tuple(history.statistics(none).first()) == (0, 0, 0, 0)
    assert feed.page(feed.feed(history.with_events(none), 4)).count() == 0
