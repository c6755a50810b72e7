"""Small formats: sizes, times, fingerprints, tokens, modes and addresses."""

from __future__ import annotations

import hashlib
import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from ..schema import MODE_NAMES

UNITS = ("KiB", "MiB", "GiB", "TiB")
# Networks that aren't public.
DENIED_V4 = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "224.0.0.0/3", "100.64.0.0/10", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24")
ALLOWED_V6 = "2000::/3"
DENIED_V6 = ("2001::/32", "2001:2::/48", "2001:10::/28", "2001:20::/28", "2001:db8::/32", "2002::/16", "3fff::/20")


def iec_bytes(n: Column, units: tuple[str, ...] = UNITS) -> Column:
    """75.67 MiB, or whole bytes below a KiB; the last of units takes whatever is larger. Halves of a hundredth go to the even one, as C's printf has it."""
    n = n.cast("long")
    out = F.concat(n.cast("string"), F.when(n == 1, " byte").otherwise(" bytes"))
    for i, unit in enumerate(units, 1):
        size = 1024**i
        cents, whole = F.pmod(n, F.lit(size)) * 100, F.shiftright(n, 10 * i)
        rest, even = F.pmod(cents, F.lit(size)), F.shiftright(cents, 10 * i)
        up = (rest > size // 2) | ((rest == size // 2) & (even % 2 == 1))
        cents = even + up.cast("long")
        shown = F.format_string("%d.%02d", whole + (cents == 100).cast("long"), cents % 100)
        out = F.when(n >= size, F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return out


def utc_timestamp(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def fingerprint(c: Column) -> Column:
    """AA:BB:... of 64 hex digits with or without colons; null for anything else."""
    hexes = F.upper(F.replace(c, F.lit(":"), F.lit("")))
    return F.when(hexes.rlike("^[0-9A-F]{64}$"), F.regexp_replace(hexes, "(..)(?!$)", "$1:"))


def mode_mask(c: Column) -> Column:
    """The audiences of a comma list of names; null where one is unknown."""
    one = lambda x: F.coalesce(*[F.when(x == k, F.lit(v)) for k, v in MODE_NAMES.items()])
    return F.aggregate(F.split(c, ","), F.lit(0), lambda acc, x: acc.bitwiseOR(one(x))).cast("long")


def page_token(since: Column, till: Column, use: Column, filters: Column, most: Column, committed: Column, id_: Column) -> Column:
    return F.concat_ws(".", F.lit("p0"), *[x.cast("string") for x in (since, till, use, filters)], F.coalesce(most.cast("string"), F.lit("-")), committed.cast("string"), id_.cast("string"))


def parse_page_token(c: Column) -> Column:
    """since, till, use, filters, most, committed and id of a token; null where it is malformed or out of its range."""
    p = F.split(c, "[.]")
    num = lambda i: F.when(F.get(p, i).rlike("^-?[0-9]{1,18}$"), F.get(p, i).cast("long"))
    ok = (F.size(p) == 8) & (F.get(p, 0) == "p0") & (num(2) >= num(1)) & (num(7) > 0) & num(6).between(num(1), num(2)) & (F.get(p, 5).rlike("^(-|[0-9]{1,18})$"))
    return F.when(ok, F.struct(num(1).alias("since"), num(2).alias("till"), num(3).alias("use"), F.get(p, 4).alias("filters"), num(5).alias("most"), num(6).alias("committed"), num(7).alias("id")))


def filter_id(mimes: list[str], body_mimes: list[str], most: int | None) -> str:
    """What a token keeps of its filters: the start of a digest of them, line by line."""
    lines = [*mimes, "body_mime_types=", *body_mimes, f"maximum_body_bytes={'-' if most is None else most}"]
    return hashlib.blake2b("".join(f"{x}\n" for x in lines).encode(), digest_size=32).hexdigest()[:16]


def _listed(filters: list[str]) -> str:
    return ",".join(filters).encode().hex() or "-"


def batch_token(since: Column, till: Column, use: Column, mimes: list[str], body_mimes: list[str], most: int | None, first: tuple[Column, Column], last: tuple[Column, Column]) -> Column:
    """Names a batch: the filters and the range of rows from a cursor (exclusive) to a row (inclusive)."""
    fixed = [F.lit(x) for x in (filter_id(mimes, body_mimes, most), _listed(mimes), _listed(body_mimes), "-" if most is None else str(most))]
    return F.concat_ws(".", F.lit("b0"), *[x.cast("string") for x in (since, till, use)], *fixed, *[x.cast("string") for x in (*first, *last)])


@F.pandas_udf(StringType())
def _filters_of(mimes: pd.Series, body_mimes: pd.Series, most: pd.Series) -> pd.Series:
    """The filter id that a token's parts have; null where they can't be read."""
    from .mime import parse_filters

    def one(a, b, n):
        try:
            lists = [[] if x == "-" else parse_filters(bytes.fromhex(x).decode()) for x in (a, b)]
            return filter_id(*lists, None if n == "-" else int(n))
        except (ValueError, TypeError):
            return None

    return pd.Series([one(*x) for x in zip(mimes, body_mimes, most, strict=True)])


def parse_batch_token(c: Column) -> Column:
    """since, till, use, filters, first and last of a token; null where it is malformed, out of its range, or its filters aren't those of its id."""
    p = F.split(c, "[.]")
    num = lambda i: F.when(F.get(p, i).rlike("^-?[0-9]{1,18}$"), F.get(p, i).cast("long"))
    key = lambda i: F.struct(num(i).alias("committed"), num(i + 1).alias("id"))
    fits = (num(2) >= num(1)) & (num(9) >= 0) & (num(11) > 0) & (num(8) >= num(1)) & (num(10) <= num(2)) & ((num(10) > num(8)) | ((num(10) == num(8)) & (num(11) > num(9))))
    own = _filters_of(F.coalesce(F.get(p, 5), F.lit("")), F.coalesce(F.get(p, 6), F.lit("")), F.coalesce(F.get(p, 7), F.lit("")))
    ok = (F.size(p) == 12) & (F.get(p, 0) == "b0") & F.get(p, 3).isin(*MODE_NAMES) & F.get(p, 7).rlike("^(-|[0-9]{1,18})$") & fits & (own == F.get(p, 4))
    return F.when(ok, F.struct(num(1).alias("since"), num(2).alias("till"), F.get(p, 3).alias("use"), F.get(p, 4).alias("filters"), key(8).alias("first"), key(10).alias("last")))


def page_tokens(page: DataFrame, since: int, till: int, use: str, filters: str, given: str | None = None) -> DataFrame:
    """One row for a feed's page: has_more, resume_token (its last row's, or what was given where it is empty) and next_token (only where more follows)."""
    end = page.agg(F.max(F.struct("committed_ms", "crawl_result_id")).alias("e"), F.coalesce(F.max("has_more"), F.lit(False)).alias("has_more"))
    token = page_token(F.lit(since), F.lit(till), F.lit(use), F.lit(filters), F.lit(None), F.col("e.committed_ms"), F.col("e.crawl_result_id"))
    last = F.when(F.col("e").isNotNull(), token)
    return end.select("has_more", F.coalesce(last, F.lit(given).cast("string")).alias("resume_token"), F.when(F.col("has_more"), last).alias("next_token"))


def pem_fingerprint(c: Column) -> Column:
    """SHA-256 of a PEM certificate's bytes, in the form of a fingerprint; null for what isn't one."""
    inner = F.regexp_extract(c, "(?s)-----BEGIN CERTIFICATE-----(.*?)-----END CERTIFICATE-----", 1)
    der = F.try_to_binary(F.regexp_replace(inner, "[ \\t\\r\\n]", ""), F.lit("base64"))
    return F.when(F.octet_length(der) > 0, fingerprint(F.sha2(der, 256)))


def compact_sql(c: Column) -> Column:
    """A statement on one line: blanks as one, cut at 400 with dots."""
    text = F.regexp_replace(F.regexp_replace(c, "[ \\t-\\r]+", " "), "^ | $", "")
    return F.when(c.isNull(), "<unknown statement>").when(F.length(text) >= 400, F.concat(F.left(text, F.lit(400)), F.lit("..."))).otherwise(text)


def public_ipv4(c: Column) -> Column:
    """Whether a dotted address is public; false for anything else."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    pattern = f"^{octet}[.]{octet}[.]{octet}[.]{octet}$"
    n = sum((F.regexp_extract(c, pattern, i).try_cast("long") * F.lit(256 ** (4 - i)) for i in range(1, 5)), F.lit(0).cast("long"))
    denied = F.lit(False)
    for net in map(ipaddress.ip_network, DENIED_V4):
        denied |= n.between(int(net.network_address), int(net.broadcast_address))
    return F.coalesce(c.rlike(pattern) & ~denied, F.lit(False))


@F.pandas_udf(BooleanType())
def is_public(text: pd.Series) -> pd.Series:
    """The same for either version; a v4 address in a v6 one counts as itself."""
    v4, v6, all6 = [ipaddress.ip_network(x) for x in DENIED_V4], [ipaddress.ip_network(x) for x in DENIED_V6], ipaddress.ip_network(ALLOWED_V6)

    def one(t) -> bool:
        try:
            a = ipaddress.ip_address(t)
        except ValueError:
            return False
        a = getattr(a, "ipv4_mapped", None) or a
        return not any(a in n for n in v4) if a.version == 4 else a in all6 and not any(a in n for n in v6)

    return text.map(one)
