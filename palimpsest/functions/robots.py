"""Robots rules for five audiences: parsing, matching and the mask of who may see a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MODES
from ..session import kept

OWN_AGENT = "palimpsest"


def agents(use: str, own: str = OWN_AGENT) -> set[str]:
    """Names under which an audience obeys: all, its own, and the crawler's; the legacy audience has the indexer's and its own."""
    return {"*", "indexer", "legacy"} if use == "legacy" else {"*", use, own}


_FIELD = "(?i)^(user-agent|allow|disallow)[ \\t]*:"
_SEGMENT = "(?im)((?:^user-agent[ \\t]*:.*\n?)+)((?:^(?:allow|disallow)[ \\t]*:.*\n?)*)"


def segments(source: Column) -> Column:
    """A robots file as an array of its groups: names (in lower case) and rules. Lines of agents with the rules right below them are a group; a blank line ends one."""
    plain = F.transform(F.split(F.replace(source, F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(F.split_part(x, F.lit("#"), F.lit(1)), F.lit(" \t")))
    told = F.filter(plain, lambda x: (x == "") | (x.rlike(_FIELD) & ~x.rlike("(?i)^(allow|disallow)[ \\t]*:$")))
    found = F.regexp_extract_all(F.array_join(told, "\n"), F.lit(_SEGMENT), F.lit(0))
    names = lambda g: F.transform(F.regexp_extract_all(g, F.lit("(?im)^user-agent[ \\t]*:[ \\t]*(.*)$"), F.lit(1)), F.lower)
    rule = lambda x: F.struct(F.lower(x).startswith("allow").alias("allow"), F.regexp_extract(x, ":[ \\t]*(.*)$", 1).alias("pattern"))
    rules = lambda g: F.transform(F.regexp_extract_all(g, F.lit("(?im)^(?:allow|disallow)[ \\t]*:.*$"), F.lit(0)), rule)
    return F.transform(found, lambda g: F.struct(names(g).alias("names"), rules(g).alias("rules")))


def robots_rules(source: str | Column, use: str, own: str = OWN_AGENT) -> Column:
    """The rules for an audience, of all groups that name it, in order; a null file has none."""
    source = F.col(source) if isinstance(source, str) else source
    mine = F.array(*map(F.lit, sorted(agents(use, own))))
    return F.flatten(F.transform(F.filter(segments(F.coalesce(source, F.lit(""))), lambda g: F.arrays_overlap(g["names"], mine)), lambda g: g["rules"]))


def pattern_regex(pattern: Column) -> Column:
    """A rule's pattern as a regular expression: * for any run, $ at the end for the end."""
    quoted = F.regexp_replace(F.regexp_replace(pattern, "[$]$", ""), "([\\\\.+?^${}()|\\[\\]])", "\\\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(pattern.endswith("$"), "$").otherwise(""))


def pattern_length(pattern: Column) -> Column:
    return F.length(F.replace(F.regexp_replace(pattern, "[$]$", ""), F.lit("*"), F.lit("")))


def path_blocked(path: Column, rules: Column) -> Column:
    """Whether the longest matching rule forbids a path; an allow wins a tie, and a rule without letters never forbids."""

    def step(acc: Column, r: Column) -> Column:
        n = pattern_length(r["pattern"])
        wins = F.regexp_like(path, pattern_regex(r["pattern"])) & ((n > acc["n"]) | ((n == acc["n"]) & r["allow"]))
        return F.when(wins, F.struct(n.alias("n"), (~r["allow"]).alias("blocked"))).otherwise(acc)

    return F.aggregate(rules, F.struct(F.lit(0).alias("n"), F.lit(False).alias("blocked")), step, lambda acc: acc["blocked"])


def compiled(source: Column, own: str = OWN_AGENT) -> Column:
    """A robots file's rules for all audiences at once, ready to be matched, the longest first and of equal ones those that allow.

    Each has mask (the audiences that it is for), allow, n (its length), head (what a path must start with), rest (what must follow, piece by piece) and ends (whether the last piece ends
    the path). A rule without letters is left out, as it forbids nothing.
    """
    uses = [(bit, F.array(*map(F.lit, sorted(agents(use, own))))) for use, bit in MODES.items()]

    def ready(mask: Column, r: Column) -> Column:
        bare = F.regexp_replace(r["pattern"], "[$]$", "")
        pieces = F.split(bare, "[*]+")
        return F.struct(mask.alias("mask"), r["allow"].alias("allow"), F.length(F.replace(bare, F.lit("*"), F.lit(""))).alias("n"), F.get(pieces, 0).alias("head"), F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))).alias("rest"), r["pattern"].endswith("$").alias("ends"))

    mask = lambda g: sum((F.when(F.arrays_overlap(g["names"], mine), bit).otherwise(0) for bit, mine in uses), F.lit(0)).cast("int")
    groups = F.transform(segments(F.coalesce(source, F.lit(""))), lambda g: F.struct(mask(g).alias("mask"), g["rules"].alias("rules")))
    rules = F.flatten(F.transform(F.filter(groups, lambda g: g["mask"] != 0), lambda g: F.transform(g["rules"], lambda r: ready(g["mask"], r))))
    longest = lambda x, y: F.when(x["n"] != y["n"], F.when(x["n"] > y["n"], -1).otherwise(1)).when(x["allow"] == y["allow"], 0).when(x["allow"], -1).otherwise(1)
    return F.array_sort(F.filter(rules, lambda r: r["n"] > 0), longest)


def _matches(path: Column, r: Column) -> Column:
    """Whether a path starts with a rule's head and has the pieces of its rest one after another, each as early as can be; the last at the end, where the rule ends there."""
    after = F.length(r["head"]) + 1
    body, last = F.slice(r["rest"], F.lit(1), F.greatest(F.size(r["rest"]) - 1, F.lit(0))), F.element_at(r["rest"], -1)

    def step(at: Column, piece: Column) -> Column:
        found = F.position(piece, path, F.greatest(at, F.lit(1)))
        return F.when((at == 0) | (found == 0), 0).otherwise(found + F.length(piece))

    found = F.aggregate(F.when(r["ends"], body).otherwise(r["rest"]), after, step)
    tail = F.when(~r["ends"], found > 0).when(F.size(r["rest"]) == 0, F.length(path) == F.length(r["head"])).otherwise((found > 0) & path.endswith(last) & (F.length(path) - F.length(last) + 1 >= found))
    return path.startswith(r["head"]) & F.when((F.size(r["rest"]) == 0) & ~r["ends"], True).otherwise(tail)


def mask_by(path: Column, rules: Column) -> Column:
    """The audiences that compiled rules let see a path: for each the first rule that is for it and matches decides; all where none does, for the robots file itself, and where there are no rules."""

    def step(acc: Column, r: Column) -> Column:
        new = r["mask"].bitwiseAND(F.bitwise_not(acc["decided"]))
        return F.when((new != 0) & _matches(path, r), F.struct(acc["decided"].bitwiseOR(new).alias("decided"), F.when(r["allow"], acc["blocked"]).otherwise(acc["blocked"].bitwiseOR(new)).alias("blocked"))).otherwise(acc)

    zero = F.lit(0).cast("int")
    blocked = F.aggregate(rules, F.struct(zero.alias("decided"), zero.alias("blocked")), step, lambda acc: acc["blocked"])
    return F.when(path == "/robots.txt", 31).otherwise(31 - F.coalesce(blocked, zero)).cast("long")


def robots_mask(path: Column, source: Column, own: str = OWN_AGENT) -> Column:
    """The audiences that may see a path by a robots file."""
    return mask_by(path, compiled(source, own))


def rule_table(files: DataFrame, own: str = OWN_AGENT) -> DataFrame:
    """authority and rules of robots files (authority, source; one each): each file is parsed here, once, however many pages are judged by it. The table is written."""
    return kept(files.select("authority", compiled(F.col("source"), own).alias("rules")), "robots-rules")


def permitted(pages: DataFrame, table: DataFrame) -> DataFrame:
    """pages (authority, path, ..) with mask: the audiences that may see each, by the rules of its authority; all where there are none."""
    return pages.join(table, "authority", "left").withColumn("mask", mask_by(F.col("path"), F.col("rules"))).drop("rules")
