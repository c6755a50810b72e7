"""What a fetch tells of its page and of others: why it is fetched again, which feed it is, which pages it leads to and where they may have a security.txt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gemtext, policy, urls
from ..functions.mime import media_type
from ..schema import TARGETS
from ..session import kept

WELL_KNOWN = "/.well-known/security.txt"


def address(url: Column, host: Column, port: Column) -> Column:
    return F.struct(url.alias("url"), urls.authority(host, port).alias("authority"))


def discovered(fetches: DataFrame, key: str) -> DataFrame:
    """key, position, url, authority and security (the address of its site's security.txt) of the pages that fetches lead to, each once, the first of equal ones.

    A redirect leads to its target, a page of gemtext to what it links; addresses go to the host that answers for them, and those that the exclusion policy names are left out.
    """
    gem = fetches.where((F.col("status_code") == 20) & ~F.col("failed") & F.col("redirected_to").isNull() & (media_type("meta") == "text/gemini"))
    linked = gemtext.outlinks(gem, key, "body", "url").select(key, "position", F.col("resolved").alias("_raw"))
    moved = fetches.where("redirected_to IS NOT NULL").select(key, F.lit(0).cast("long").alias("position"), F.col("redirected_to").alias("_raw"))
    rows = urls.canonical_alias(linked.unionByName(moved), "_raw", "url")
    # written, so that no filter on an address is pushed down into the expressions that made it
    once = kept(rows.groupBy(key, "url").agg(F.min("position").alias("position")), "links").where("url IS NOT NULL")
    allowed = policy.with_exclusion(urls.parts(once)).where("exclusion IS NULL")
    return allowed.select(key, "position", "url", urls.authority(F.col("host"), F.col("port")).alias("authority"), urls.security_txt(F.col("scheme"), F.col("host"), F.col("port")).alias("security"))


def judged(fetches: DataFrame, key: str = "url") -> DataFrame:
    """fetches (url, status_code, meta, body as text, failed, redirected_to; one row for each key) with evaluated, retire, targets, feed_type, security_evaluated, has_security, links and probes, as a batch to publish has them.

    A security.txt is judged by what it is; any other 2x by its place and body; a 5x retires a page. probes: the security.txt of the page's own site and of each page that it leads to.
    """
    p = urls.parts(fetches, "url", "_")
    there = ~F.col("failed") & F.col("status_code").isNotNull()
    decade = F.floor(F.col("status_code") / 10)
    security = there & (F.col("_param") == "") & (F.col("_path") == WELL_KNOWN)
    good = there & ~security & (decade == 2)
    subscribed = gemtext.subscribed(fetches.where("body IS NOT NULL").select(key, "body", F.col("url").alias("_own")), key, "body", "_own")
    rows = p.join(subscribed.select(key, "is_feed"), key, "left")
    kind = F.coalesce(media_type("meta"), F.lit(""))
    signs = gemtext.feed_signs("meta", F.col("_path"), F.coalesce("is_feed", F.lit(False)) & (kind == "text/gemini"), F.coalesce(gemtext.is_atom("body"), F.lit(False)))
    bits = F.lit(0)
    for name, bit in (("gemsub", TARGETS["gemsub"]), ("atom", TARGETS["feed"]), ("rss", TARGETS["feed"]), ("twtxt", TARGETS["feed"])):
        bits = bits.bitwiseOR(F.when(signs[name], bit).otherwise(0))
    home = urls.page_kind(F.col("_scheme"), F.col("_path"), F.col("_param")) * TARGETS["homepage"]
    rows = rows.withColumns({
        "evaluated": security | good, "retire": there & ~security & ~good & (decade == 5), "targets": F.when(security, TARGETS["security"]).when(good, home.bitwiseOR(bits)).otherwise(0).cast("long"), "feed_type": F.when(good, gemtext.first_sign(signs)),
        "security_evaluated": security, "has_security": security & (decade == 2) & (kind == "text/plain"), "_site": urls.security_txt(F.col("_scheme"), F.col("_host"), F.col("_port")), "_authority": urls.authority(F.col("_host"), F.col("_port")),
    })
    led = discovered(fetches, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "url", "authority", "security"))).alias("_led"))  # the links of one body
    rows = rows.join(led, key, "left").withColumn("_led", F.coalesce("_led", F.array().cast(led.schema["_led"].dataType)))
    links = F.transform("_led", lambda x: F.struct(x["url"].alias("url"), x["authority"].alias("authority")))
    own = F.array(F.struct(F.col("_site").alias("url"), F.col("_authority").alias("authority")))
    probes = F.array_distinct(F.concat(own, F.transform("_led", lambda x: F.struct(x["security"].alias("url"), x["authority"].alias("authority")))))
    made = ["evaluated", "retire", "targets", "feed_type", "security_evaluated", "has_security"]
    truth = [F.coalesce(c, F.lit(False)).alias(c) if c not in ("targets", "feed_type") else F.col(c) for c in made]
    return rows.select(*fetches.columns, *truth, links.alias("links"), probes.alias("probes"))
