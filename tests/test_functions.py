import pytest
from pyspark.sql import functions as F

from palimpsest.functions import formats, gemtext, mime, policy, robots, urls


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(("n", "want"), [(0, "0 bytes"), (1, "1 byte"), (812, "812 bytes"), (2560, "2.50 KiB"), (7 << 20, "7.00 MiB"), (3 << 31, "6.00 GiB")])
def test_bytes(spark, n, want):
    assert one(spark, n, formats.iec_bytes, "long") == want


@pytest.mark.parametrize(("n", "want"), [(5 << 42, "20480.00 GiB"), (1 << 40, "1024.00 GiB"), (1152, "1.12 KiB"), (1408, "1.38 KiB"), ((1 << 20) - 1, "1024.00 KiB"), ((9 << 60) // 10, "966367641.60 GiB")])
def test_bytes_up_to_a_unit(spark, n, want):
    """The largest unit takes the rest; halves go to the even digit, and nothing is lost beyond 2^53."""
    assert one(spark, n, lambda c: formats.iec_bytes(c, formats.UNITS[:3]), "long") == want


@pytest.mark.parametrize("name", ["iec_bytes", "statistics_document"])
def test_sizes_of_a_larger_history(spark, duck, tmp_path, name):
    """Numbers beyond a TiB, and sums beyond a GiB, as the SQL writes them."""
    import duckdb

    from palimpsest.plans import queries as plans

    duck.sql("FROM events").create_view("one_day")
    rows = "SELECT event_id * 997 AS event_id, event_type, user_id, ts, props FROM one_day UNION ALL SELECT event_id * 997 + 10000000 + r, event_type, user_id, ts, props FROM one_day, range(1, 90) t(r)"
    duck.sql(rows).write_parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    c.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    out = c.sql(plans.SQL[name])
    df = plans.QUERIES[name](spark, str(tmp_path))
    assert sorted(map(tuple, df.select(out.columns).collect())) == sorted(out.fetchall())


def test_fingerprint(spark):
    assert one(spark, "ab" * 32, formats.fingerprint) == ":".join(["AB"] * 32)
    assert one(spark, ":".join(["ab"] * 32), formats.fingerprint) == ":".join(["AB"] * 32)
    assert one(spark, "ab" * 31, formats.fingerprint) is None


@pytest.mark.parametrize(
    ("text", "want"),
    [("\tIMAGE/Png", "image/png"), ("video/ogg;codecs=a;level=2", "video/ogg"), ('text/csv ; header="a;b"', "text/csv"), ("audio/", None), ("/mpeg", None), ("text/csv ; =x", None), (" ", None), (None, None)],
)
def test_media_type(spark, text, want):
    assert one(spark, text, mime.media_type) == want


def test_filters():
    assert mime.parse_filters("image%2Fpng,Audio/*,audio/*,*/*") == ["image/png", "audio/*", "*"]
    with pytest.raises(ValueError):
        mime.parse_filters("image/png,,")


ADDRESSES = {
    "10.200.3.4": False, "11.0.0.1": True, "100.63.255.255": True, "100.127.0.9": False, "127.9.9.9": False, "172.15.0.1": True, "172.31.255.255": False, "192.88.99.7": False, "198.19.4.4": False, "223.255.255.255": True, "240.0.0.1": False, "9.9.9.9": True,
    "2a00:1450::5": True, "::ffff:9.9.9.9": True, "::ffff:10.1.2.3": False, "2001:db8:7::": False, "3fff:1::": False, "fd12::1": False, "256.1.1.1": False, "": False,
}


def test_addresses(spark):
    from palimpsest.session import ship

    ship(spark)
    df = spark.createDataFrame([(a,) for a in ADDRESSES], "a string").select("a", formats.is_public("a").alias("p"), formats.public_ipv4(F.col("a")).alias("p4")).collect()
    assert {r.a: r.p for r in df} == ADDRESSES
    assert all(r.p4 == (ADDRESSES[r.a] and ":" not in r.a) for r in df)


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("GEMINI://Capsule.Test:1965/one/./two/../three?k=V#x", "gemini://capsule.test/one/three?k=V"),
        ("gemini://capsule.test", "gemini://capsule.test/"),
        ("gemini://capsule.test:7070//log///", "gemini://capsule.test:7070/log/"),
        ("gemini://capsule.test/../..", "gemini://capsule.test/"),
        ("gemini:///nohost", None),
        ("just words", None),
    ],
)
def test_canonical(spark, url, want):
    assert urls.canonical(spark.createDataFrame([(url,)], "url string")).first().canonical == want


@pytest.mark.parametrize(
    ("ref", "want"),
    [
        ("next.gmi", "gemini://capsule.test/log/next.gmi"),
        ("./a/../b#c", "gemini://capsule.test/log/b"),
        ("#only", "gemini://capsule.test/log/first?page=2"),
        ("?page=3", "gemini://capsule.test/log/first?page=3"),
        ("/top", "gemini://capsule.test/top"),
        ("../../../out", "gemini://capsule.test/out"),
        ("gopher://capsule.test/", None),
        ("tel:123", None),
        ("//elsewhere.test/x", None),
        ("gemini://elsewhere.test:1965/y?z", "gemini://elsewhere.test/y?z"),
        ("two\rlines", None),
    ],
)
def test_resolve(spark, ref, want):
    assert urls.resolve(spark.createDataFrame([("gemini://capsule.test/log/first?page=2", ref)], "base string, ref string"), "base", "ref").first().resolved == want


def test_path_fold(spark):
    cases = {"/": "/", "/x/./y": "/x/y", "/x/y/z/../..": "/x/", "/../../x": "/x", "/x/./": "/x/", "///": "/", "/x/..y": "/x/..y"}
    rows = spark.createDataFrame([(p,) for p in cases], "p string").select("p", urls.fold_path(F.col("p")).alias("r")).collect()
    assert {r.p: r.r for r in rows} == cases


ROBOTS = "# of a capsule\nUser-agent: *\nDisallow: /hidden\nAllow: /hidden/but/open\nDisallow: /*.zip$\n"


@pytest.mark.parametrize(
    ("path", "source", "mask"),
    [
        ("/log", None, 31),
        ("/log", "no rules here", 31),
        ("/hidden/x", ROBOTS, 0),
        ("/hidden/but/open/x", ROBOTS, 31),
        ("/a.zip", ROBOTS, 0),
        ("/a.zip.txt", ROBOTS, 31),
        ("/robots.txt", "User-agent: *\nDisallow: /", 31),
        ("/q", "user-AGENT : researcher # one\nUser-agent: webproxy\n disallow : /q", 7),
        ("/q", "User-agent: researcher\nDisallow: /q\nUser-agent: webproxy\nDisallow: /r", 23),
        ("/q", "User-agent: researcher\n\nDisallow: /q", 31),
        ("/q", "User-agent: researcher\nDisallow:\nUser-agent: webproxy\nDisallow: /q", 7),
        ("/q", "Disallow: /q\r\nUser-agent:\r\nDisallow: /q\r\n", 31),
        ("/q", f"User-agent: {robots.OWN_AGENT}\nDisallow: /q", 1),
        ("/q", "User-agent: *\nDisallow: $", 31),
    ],
)
def test_robots(spark, path, source, mask):
    assert spark.createDataFrame([(path, source)], "p string, s string").select(robots.robots_mask(F.col("p"), F.col("s")).alias("m")).first().m == mask


@pytest.mark.parametrize(
    ("path", "pattern", "blocked"),
    [("/u/anna/drafts", "/u/*/drafts$", True), ("/u/anna/drafts/1", "/u/*/drafts$", False), ("/c++/x", "/c++", True), ("/ccc/x", "/c++", False), ("/x(1)", "/x(1)$", True)],
)
def test_robots_patterns(spark, path, pattern, blocked):
    rules = F.array(F.struct(F.lit(False).alias("allow"), F.lit(pattern).alias("pattern")))
    assert spark.createDataFrame([(path,)], "p string").select(robots.path_blocked(F.col("p"), rules).alias("b")).first().b is blocked


def test_compiled_rules_against_regular_expressions(spark):
    """Random rules and paths: what compiled rules say of all audiences at once is what trying each rule's regular expression says of each."""
    import random
    import re

    rng = random.Random(7)
    rows = []
    for _ in range(150):
        groups = [(rng.sample(["*", "archiver", "webproxy", "indexer", "nobody"], rng.randrange(1, 3)), [(rng.random() < 0.4, "".join(rng.choice("//ab*.$"[: 7 if i else 1]) for i in range(rng.randrange(1, 7)))) for _ in range(rng.randrange(1, 5))]) for _ in range(rng.randrange(1, 4))]
        source = "\n\n".join("\n".join([*(f"User-agent: {n}" for n in names), *(f"{'Allow' if a else 'Disallow'}: {p}" for a, p in rules)]) for names, rules in groups)
        rows += [("/" + "".join(rng.choice("ab/.") for _ in range(rng.randrange(6))), source, groups) for _ in range(4)]

    def want(path, groups):
        mask = 0
        for use, bit in robots.MODES.items():
            best = (0, True)
            for names, rules in groups:
                if robots.agents(use) & set(names):
                    for allow, p in rules:
                        body = p.removesuffix("$")
                        if re.match("".join(".*" if c == "*" else re.escape(c) for c in body) + ("$" if p.endswith("$") else ""), path):
                            best = max(best, (len(body.replace("*", "")), allow))
            mask |= bit * best[1]
        return mask

    got = spark.createDataFrame([(i, p, s) for i, (p, s, _) in enumerate(rows)], "i long, p string, s string").select("i", robots.robots_mask(F.col("p"), F.col("s")).alias("m")).collect()
    assert {r.i: r.m for r in got} == {i: want(p, g) for i, (p, _, g) in enumerate(rows)}


def test_files_are_parsed_once(spark):
    """Pages meet ready rules: their plan has no parsing, and a hot authority's file is parsed once as any other."""
    files = spark.createDataFrame([("a:1965", ROBOTS), ("b:1965", None)], "authority string, source string")
    pages = spark.range(300).selectExpr("id", "CASE id % 3 WHEN 0 THEN 'b:1965' WHEN 1 THEN 'c:1965' ELSE 'a:1965' END AS authority", "CASE WHEN id % 2 = 0 THEN '/hidden/x' ELSE '/open' END AS path")
    out = robots.permitted(pages, robots.rule_table(files))
    assert {(r.authority, r.path, r["mask"]) for r in out.collect()} == {("a:1965", "/hidden/x", 0), ("a:1965", "/open", 31), ("b:1965", "/hidden/x", 31), ("b:1965", "/open", 31), ("c:1965", "/hidden/x", 31), ("c:1965", "/open", 31)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract" not in plan and "RLIKE" not in plan.upper()


EXCLUDED = {
    "gemini://orchard.test/git/apples/notes.gmi": "git",
    "gemini://orchard.test/pears/blame/main.c": "git",
    "gemini://orchard.test/web?p=pears;a=patch": "git",
    "gemini://git.orchard.test/": "git",
    "gemini://orchard.test/digit/8": None,
    "gemini://orchard.test/svnweb/plums": "svn",
    "gemini://orchard.test/plums?peg=12": "svn",
    "gemini://orchard.test/shelf/branch": None,
    "gemini://taz.de/politik": "known-unbounded-or-mirror",
    "gemini://godocs.io.orchard.test/": "known-unbounded-or-mirror",
    "gemini://taz.dev/": None,
    "gemini://buffering.party/tarpit": "tarpit",
    "gemini://buffering.party/tar": None,
    "gemini://orchard.test/search?ripe": "search-query",
    "gemini://orchard.test/search/ripe": None,
    "gemini://orchard.test/run/Test_all.CGI": "test-script",
    "gemini://sava.rocks/fun-stuff/harvest-countdown/9": "countdown-generator",
    "gemini://orchard.test/gemski/play/3": "gemski-generator",
    "gemini://gem.pwarren.id.au/cgi-bin/maze.cgi": "maze-generator",
    "gemini://orchard.test/cgi-bin/maze.cgi": None,
    "gemini://ftrv.se/": "host",
    "gemini://far.ftrv.se/": None,
    "gemini://orchard.test:443/": "port-443",
    "gemini://pear.onion/": "hidden-service",
    "gemini://pear.localdomain/": "local-address",
    "gemini://orchard.test/a/old/archive/cached?x": "archive-cached-view",
    "gemini://orchard.test/fig/fig/jam/fig": "repeated-path-component",
    "gemini://orchard.test/ring/rand.gmi": "webring-navigation",
    "gemini://orchard.test/~xkcd/1": "xkcd-archive",
    "gemini://orchard.test/rfc-mirrors": "proxy-or-mirror",
    "gemini://orchard.test/a\x0bb": "control-character",
    "gemini://orchard.test/allcommits/9f/tree.txt": "commit-history",
}


def test_exclusion(spark):
    rows = policy.with_exclusion(urls.parts(spark.createDataFrame([(u,) for u in EXCLUDED], "url string"))).collect()
    assert {r.url: r.exclusion for r in rows} == EXCLUDED and {x for x in EXCLUDED.values() if x} == set(policy.REASONS)


def test_prefix_search(spark):
    """The binary search against a try of every prefix, nested ones and texts between them included."""
    prefixes = ("b", "ba", "bb/", "d/x", "d/y", "é", "m", "zz")
    texts = ["", "a", "b", "ba", "bz", "c", "d", "d/", "d/x", "d/w", "d/y1", "d/z", "e", "é", "éa", "l", "m", "mm", "n", "z", "zz", "zzz", "zy"]
    for some in (prefixes, prefixes[2:], prefixes[:1], ()):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", policy.starts_with_any(F.col("t"), some).alias("r")).collect()
        assert {r.t: r.r for r in got} == {t: t.startswith(some) for t in texts}
    deep = policy.starts_with_any(F.col("t"), policy.PREFIXES)._jc.toString()
    assert deep.count("startswith") + deep.count("StartsWith") <= len(policy.PREFIXES)


def test_rewrite(spark):
    body = "# Jam\n=> plums.gmi   Plum jam\n=>/?sort=old Old jars\n=> gemini://cellar.test:7070/shelf Shelf\n=> tel:12 Call\n```\n=> plums.gmi\n```\n=> mailto:x"
    want = "# Jam\n=> /archive/gemini/x/jam.test%2Frecipes%2Fplums.gmi   Plum jam\n=>/archive/gemini/x/jam.test%2F/param/sort%3Dold Old jars\n=> /archive/gemini/x/cellar.test%3A7070%2Fshelf Shelf\n=> tel:12 Call\n```\n=> plums.gmi\n```\n=> mailto:x"
    df = spark.createDataFrame([(1, body, "gemini://jam.test/recipes/index.gmi")], "k long, body string, url string")
    assert gemtext.rewritten(df, "k", "body", "url").first().body == want
    assert [r.resolved for r in gemtext.outlinks(df, "k", "body", "url").orderBy("position").collect()] == ["gemini://jam.test/recipes/plums.gmi", "gemini://jam.test/?sort=old", "gemini://cellar.test:7070/shelf"]


def test_feeds(spark):
    from palimpsest.session import ship

    ship(spark)
    dated = "=> a 2024-01-01 one\n=> b 2024-1-2\n=> c 2024-01-03 x\n"
    broken = "=> a 2024-01-01\n=> b 2024-1-2\ntext\n=> c 2024-01-03\n"
    df = spark.createDataFrame([(1, dated, "gemini://h/"), (2, broken, "gemini://h/"), (3, None, "gemini://h/")], "k long, body string, url string")
    assert {r.k: r.is_feed for r in gemtext.subscribed(df, "k", "body", "url").collect()} == {1: True, 2: False}
    atom = spark.createDataFrame([('<feed xmlns="http://www.w3.org/2005/Atom"/>',), ("<feed/>",), ("<feed",), (None,)], "b string").select(gemtext.is_atom("b").alias("a")).collect()
    assert [r.a for r in atom] == [True, False, False, False]


def test_token(spark):
    df = spark.createDataFrame([("p0.1.9.4.abc.-.5.7",), ("p0.9.1.4.abc.-.5.7",), ("p0.1.9.4.abc.-.5.0",), ("p0.1.9.4.abc.x.5.7",), ("b0",)], "t string").select(formats.parse_page_token(F.col("t")).alias("r")).collect()
    assert [r.r is not None for r in df] == [True, False, False, False, False]
    assert (df[0].r.since, df[0].r.id, df[0].r.most) == (1, 7, None)
