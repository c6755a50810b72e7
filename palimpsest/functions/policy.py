"""Crawl exclusion: why a URL isn't fetched, the first of an ordered list of rules."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mime import ascii_lower

# Hosts, URL prefixes and route words that results depend on.
LOCAL_HOSTS = ("localhost", "localhost.localdomain", "[::1]")
LOCAL_ENDS = (".local", ".localhost", ".localdomain")
HOSTS = ("example.com", "example.org", "example.net", "example.io", "example.us", "example.eu", "example.gov", "example.space")
DEAD_HOSTS = ("gus.guru", "ftrv.se", "git.thebackupbox.net", "mikelynch.org", "campaignwiki.org")
GIT_ROUTES = ("commit", "commits", "tree", "blob", "blame", "log", "patch", "diff", "raw")
SVN_ROUTES = ("svn", "svnroot", "viewvc", "viewcvs", "svnweb", "changeset", "trunk", "branches")
WEBRING = ("/next.cgi", "/prev.cgi", "/rand.cgi", "/next", "/prev", "/rand", "/next.gmi", "/prev.gmi", "/rand.gmi")
PREFIXES = (
    "gemini://www.youtube.com/",
    "gemini://tictactoe.lanterne.chilliet.eu",
    "gemini://mirrors.apple2.org.za/active/",
    "gemini://mirrors.apple2.org.za/archive/",
    "gemini://kamalatta.ddnss.de/",
    "gemini://tweek.zyxxyz.eu/valentina/",
    "gemini://ansi.hrtk.in/",
    "gemini://matrix.kiwifarms.net",
    "gemini://songs.zachdecook.com/song.gmi.php/",
    "gemini://songs.zachdecook.com/chord.svg/",
    "gemini://gemini.zachdecook.com/cgi-bin/ccel.sh",
    "gemini://cadence.moe/chapo/",
    "gemini://nixo.xyz/reply/",
    "gemini://nixo.xyz/notify",
    "gemini://gemini.thebackupbox.net/queryresponse",
    "gemini://gem.garichankar.com/share_audio",
    "gemini://vps01.rdelaage.ovh/",
    "gemini://mastogem.picasoft.net",
    "gemini://runjimmyrunrunyoufuckerrun.com/fonts/",
    "gemini://runjimmyrunrunyoufuckerrun.com/tmp/",
    "gemini://houston.coder.town/search?",
    "gemini://houston.coder.town/search/",
    "gemini://marginalia.nu/search",
    "gemini://kennedy.gemi.dev/cached?",
    "gemini://kennedy.gemi.dev/archive/",
    "gemini://g.619.hu/repo.gmi",
    "gemini://gem.snork.ca/textfiles.com/",
    "gemini://gem.snork.ca/rfc-editor.org/",
    "gemini://uc.cthulhu28.space/v16/",
    "gemini://gemini.autonomy.earth/current_month/archive/",
    "gemini://gemhoo.zone/mirrors/textfiles/",
    "gemini://r13.xyz/games/bell-below/",
    "gemini://neuz.r13.xyz/month/",
    "gemini://kennedy.gemi.dev/observatory/",
    "gemini://kennedy.gemi.dev/page-info?",
    "gemini://kennedy.gemi.dev/reports/",
    "gemini://geddit.pitr.ca/post?",
    "gemini://geddit.pitr.ca/c/",
    "gemini://geddit.glv.one/post?",
    "gemini://geddit.glv.one/c/",
    "gemini://gemini.marmaladefoo.com/cgi-bin/calc.cgi?",
    "gemini://gemini.circumlunar.space/users/fgaz/calculator/",
    "gemini://acidic.website/cgi-bin/weather.tcl?",
    "gemini://caolan.uk/weather/",
    "gemini://alexschroeder.ch/",
    "gemini://mozz.us/files/gemini-links.gmi",
    "gemini://gem.benscraft.info/mailing-list",
    "gemini://rawtext.club/~sloum/geminilist",
    "gemini://gemini.techrights.org/",
    "gemini://pon.ix.tc/cgi-bin/youtube.cgi?",
    "gemini://pon.ix.tc/youtube/",
    "gemini://taz.de/",
    "gemini://simplynews.metalune.xyz",
    "gemini://illegaldrugs.net/cgi-bin/news.php?",
    "gemini://illegaldrugs.net/cgi-bin/reader",
    "gemini://rawtext.club/~sloum/geminews",
    "gemini://gemini.cabestan.tk/hn",
    "gemini://hn.filiuspatris.net/",
    "gemini://schmittstefan.de/de/nachrichten/",
    "gemini://gmi.noulin.net/mobile",
    "gemini://jpfox.fr/rss/",
    "gemini://illegaldrugs.net/cgi-bin/news.php/",
    "gemini://dw.schettler.net/",
    "gemini://dioskouroi.xyz/top",
    "gemini://drewdevault.com/cgi-bin/hn.py",
    "gemini://tobykurien.com/maverick/",
    "gemini://gemini.knusbaum.com",
    "gemini://wp.pitr.ca/",
    "gemini://wp.glv.one/",
    "gemini://wikipedia.geminet.org/",
    "gemini://wikipedia.geminet.org:1966",
    "gemini://vault.transjovian.org/",
    "gemini://egsam.pitr.ca/",
    "gemini://egsam.glv.one/",
    "gemini://gemini.conman.org/test",
    "gemini://chat.mozz.us/stream",
    "gemini://chat.mozz.us/submit",
    "gemini://80h.dev/agena/",
    "gemini://astrobotany.mozz.us/app/",
    "gemini://carboncopy.xyz/cgi-bin/apache.gex/",
    "gemini://gemini.susa.net/cgi-bin/search?",
    "gemini://gemini.susa.net/cgi-bin/twitter?",
    "gemini://gemini.susa.net/cgi-bin/vim-search?",
    "gemini://gemini.susa.net/cgi-bin/links_stu.lua?",
    "gemini://gemini.spam.works/textfiles/",
    "gemini://gemini.spam.works/mirrors/textfiles/",
    "gemini://gemini.spam.works/users/dvn/archive/",
    "gemini://gemini.thebackupbox.net/radio",
    "gemini://higeki.jp/radio",
    "gemini://drewdevault.com/cgi-bin/web.sh?",
    "gemini://gemiprox.pollux.casa/",
    "gemini://gemiprox.pollux.casa:1966",
    "gemini://ecs.d2evs.net/proxy/",
    "gemini://gmi.si3t.ch/www-gem/",
    "gemini://orrg.clttr.info/orrg.pl",
    "gemini://mysidard.com/services/hackernews/",
    "gemini://gem.denarii.cloud/",
    "gemini://cfdocs.wetterberg.nu/",
    "gemini://godocs.io",
    "gemini://emacswiki.org/",
    "gemini://si3t.ch/code/",
    "gemini://tilde.club/~filip/library/",
    "gemini://gemini.bortzmeyer.org/rfc-mirror/",
    "gemini://chris.vittal.dev/rfcs",
    "gemini://going-flying.com/git/cgi/gemini.git/",
    "gemini://szczezuja.flounder.online/git/",
    "gemini://gmi.noulin.net/rfc",
    "gemini://gmi.noulin.net/man",
    "gemini://hellomouse.net/user-pages/handicraftsman/ietf/",
    "gemini://tilde.team/~orichalcumcosmonaut/darcs/website/prod/",
    "gemini://gemini.omarpolo.com/cgi",
    "gemini://gemini.rmf-dev.com",
    "gemini://musicbrainz.uploadedlobster.com/",
    "gemini://gemini.lost-frequencies.eu/posts/archive",
    "gemini://blitter.com/",
    "gemini://ake.crabdance.com:1966/message/",
    "gemini://iceworks.cc/z/",
    "gemini://ake.crabdance.com:1966/channel/",
    "gemini://gemini.autonomy.earth/posts/",
    "gemini://lists.flounder.online/gemini/threads/messages/",
    "gemini://tilde.pink/~bencollver/gamefaqs/",
    "gemini://tilde.pink/~bencollver/gamefaq/",
    "gemini://gemini.quux.org/0/Archives",
    "gemini://gemini.rob-bolton.co.uk/songs",
    "gemini://gthudson.xyz/cgi-bin/quietplace.cgi",
    "gemini://futagoza.gamiri.com/gmninkle/",
    "gemini://alexey.shpakovsky.ru/maze",
    "gemini://jsreed5.org/live/cgi-bin/twisty/",
    "gemini://gemini.theuse.net/",
    "gemini://202x.moe/resonance",
    "gemini://gmi.skyjake.fi/",
    "gemini://warmedal.se/.well-known/",
    "gemini://www.bonequest.com/",
    "gemini://kennedy.gemi.dev/page-info?id=",
    "gemini://gemi.dev/xkcd",
    "gemini://gemi.dev/cgi-bin/",
    "gemini://gemlog.stargrave.org/",
    "gemini://jsreed5.org/oeis/",
)


def starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a text starts with one of the prefixes: a binary search in their sorted list.

    Of prefixes that start with others only the others are kept. Then a text that starts with one has that one as the greatest that isn't above the text, as whatever lies between the two starts with
    it. So a few comparisons find the only candidate, as one expression, however many prefixes there are.
    """
    kept: list[str] = []
    for p in sorted(prefixes, key=lambda p: p.encode()):
        if not kept or not p.startswith(kept[-1]):
            kept.append(p)

    def search(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return text.startswith(kept[lo])
        mid = (lo + hi) // 2
        return F.when(text < kept[mid], search(lo, mid)).otherwise(search(mid, hi))

    return search(0, len(kept)) if kept else F.lit(False)


def _rules(r: Column) -> list[tuple[str, Column]]:
    """Reasons and their conditions over an address r (url, host, port, path, lpath in ASCII lower case, param), in order."""
    url, host, path, lpath, param = (r[c] for c in ("url", "host", "path", "lpath", "param"))
    ends = lambda c, xs: reduce(or_, [c.endswith(x) for x in xs])
    has = lambda c, xs: reduce(or_, [c.contains(x) for x in xs])
    on_route = lambda names: F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))
    action = [f"a={x}" for x in GIT_ROUTES if x != "raw"]
    thrice = F.exists(F.split(path, "/"), lambda x: (x != "") & (F.size(F.filter(F.split(path, "/"), lambda y: y == x)) >= 3))
    return [
        ("port-443", r["port"] == 443),
        ("local-address", host.isin(*LOCAL_HOSTS) | host.startswith("127.0.0.") | ends(host, LOCAL_ENDS)),
        ("hidden-service", host.endswith(".onion")),
        ("host", host.isin(*HOSTS, *DEAD_HOSTS)),
        ("tarpit", (host == "buffering.party") & ((path == "/tarpit") | path.startswith("/tarpit/"))),
        ("known-unbounded-or-mirror", starts_with_any(url, PREFIXES)),
        ("git", path.startswith("/git/") | host.startswith("git.") | url.contains(".git/") | on_route(GIT_ROUTES) | has(param, action) | url.endswith("/git.sh")),
        ("svn", url.contains("/.svn/") | on_route(SVN_ROUTES) | has(param, ("pathrev=", "peg="))),
        ("xkcd-archive", has(url, ("/~xkcd/", "/xkcd/"))),
        ("maze-generator", (host == "gem.pwarren.id.au") & (lpath == "/cgi-bin/maze.cgi")),
        ("archive-cached-view", lpath.endswith("/archive/cached") & (param != "")),
        ("test-script", lpath.contains("test_") & has(lpath, (".py", ".cgi"))),
        ("gemski-generator", lpath.startswith("/gemski/play") | lpath.startswith("/ski/play")),
        ("countdown-generator", (host == "sava.rocks") & lpath.startswith("/fun-stuff/") & lpath.contains("-countdown/")),
        ("search-query", lpath.isin("/search", "/search/") & (param != "")),
        ("webring-navigation", ends(path, WEBRING)),
        ("proxy-or-mirror", has(url, ("gopher:/:/", "rfc-mirror"))),
        ("control-character", url.rlike("[\\x01-\\x1f]")),
        ("repeated-path-component", thrice),
        ("commit-history", url.rlike("^((?!commits/).)*commits/[0-9A-Za-z]*/.")),
    ]


#: All reasons, in the order in which they are tried.
REASONS = (
    "port-443", "local-address", "hidden-service", "host", "tarpit", "known-unbounded-or-mirror", "git", "svn", "xkcd-archive", "maze-generator", "archive-cached-view", "test-script", "gemski-generator", "countdown-generator", "search-query", "webring-navigation", "proxy-or-mirror",
    "control-character", "repeated-path-component", "commit-history",
)


def with_exclusion(df):
    """df (url, host, port, path, param) with exclusion: the reason, null where the page may be fetched.

    The parts are bound once, as the variable of a function over an array of one, so that no optimiser puts their expressions into each of the rules.
    """
    one = F.struct(*[F.col(c).alias(c) for c in ("url", "host", "port", "path", "param")], ascii_lower(F.col("path")).alias("lpath"))

    def first(r: Column) -> Column:
        return reduce(lambda out, rule: out.when(rule[1], rule[0]), _rules(r), F)

    return df.withColumn("exclusion", F.get(F.transform(F.array(one), first), 0))
