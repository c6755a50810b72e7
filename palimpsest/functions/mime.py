"""Media types by the grammar of RFC 2045, and filters on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[!#$%&'*+.^_`|~0-9A-Za-z-]+"
QUOTED = r'"(?:[^"\\]|\\.)*"'
BLANK = r"[ \t]*"
#: The whole grammar: any error, even a semicolon at the end, makes no match.
MEDIA = f"^{BLANK}({TOKEN})/({TOKEN}){BLANK}(?:;{BLANK}{TOKEN}=(?:{TOKEN}|{QUOTED}){BLANK})*$"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def media_type(c: str | Column) -> Column:
    """type/subtype in lower case, null for what isn't one."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(MEDIA), ascii_lower(F.concat(F.regexp_extract(c, MEDIA, 1), F.lit("/"), F.regexp_extract(c, MEDIA, 2))))


def body_matches(c: str | Column, filters: list[str]) -> Column:
    """The strict filter on bodies: all, an exact type, or type/*."""
    if not filters or "*" in filters:
        return F.lit(True)
    kind, out = media_type(c), F.lit(False)
    for f in filters:
        out |= kind.startswith(f[:-1]) if f.endswith("/*") else kind == f
    return F.coalesce(out, F.lit(False))


def parse_filters(text: str) -> list[str]:
    """A comma list of filters from a route; an invalid one refuses the list."""
    import re
    from urllib.parse import unquote

    out: list[str] = []
    for f in unquote(text).split(","):
        f = f.strip(" \t")
        f = "*" if f in ("*", "*/*") else f.lower()
        if f != "*" and not re.fullmatch(rf"{TOKEN}/(\*|{TOKEN})", f):
            raise ValueError(f"invalid media filter: {f!r}")
        if f not in out:
            out.append(f)
    return out
