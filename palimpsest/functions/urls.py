"""Gemini URLs: parts, canonical form, resolution of references, and what is derived from them.

A host ends at the first colon or slash; percent-encoding is never decoded; dot segments are folded in the path alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mime import ascii_lower

# Ports that schemes imply.
DEFAULT_PORTS = {"http": 80, "https": 443, "gemini": 1965, "gopher": 70, "ftp": 21}
HEAD = "^([0-9A-Za-z]+)://([^:/.][^:/]*)"
PORT = HEAD + ":([0-9]+)"
TAIL = HEAD + "(?::[0-9]+)?(/[^?#]*)?"
QUERY = HEAD + "(?::[0-9]+)?/[^?#]*[?]([^#]*)"
FRAGMENT = HEAD + "(?::[0-9]+)?/[^#]*#(.*)$"


def fold_path(path: Column) -> Column:
    """The path without empty, . and .. segments; a slash at the end stays, and stands for a dot segment there."""
    def step(acc: Column, x: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(x.isin("", "."), acc).when(x == "..", up).otherwise(F.array_append(acc, x))

    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(path.rlike("(/|/[.]|/[.][.])$") & (joined != "/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def default_port(scheme: Column) -> Column:
    out = F.lit(0)
    for k, v in DEFAULT_PORTS.items():
        out = F.when(scheme == k, v).otherwise(out)
    return out.cast("long")


def parts(df: DataFrame, col: str = "url", prefix: str = "") -> DataFrame:
    """Adds scheme, host, port (the scheme's own by default), path, param and fragment; all null for what isn't a URL."""
    c = F.col(col)
    ok = c.rlike(HEAD + "($|[:/])")
    get = lambda p, i: F.when(ok, F.regexp_extract(c, p, i))
    scheme = ascii_lower(get(HEAD, 1))
    port = F.coalesce(F.expr(f"try_cast(regexp_extract({col}, r'{PORT}', 3) AS BIGINT)"), default_port(scheme))
    return df.withColumns(
        {
            f"{prefix}scheme": scheme,
            f"{prefix}host": ascii_lower(get(HEAD, 2)),
            f"{prefix}port": F.when(ok, port),
            f"{prefix}path": F.when(ok, fold_path(F.concat(F.lit("/"), get(TAIL, 3)))),
            f"{prefix}param": get(QUERY, 3),
            f"{prefix}fragment": get(FRAGMENT, 3),
        }
    )


def compose(scheme: Column, host: Column, port: Column, path: Column, param: Column) -> Column:
    at = F.when(port == default_port(scheme), F.lit("")).otherwise(F.concat(F.lit(":"), port.cast("string")))
    query = F.when(param == "", F.lit("")).otherwise(F.concat(F.lit("?"), param))
    return F.concat(scheme, F.lit("://"), host, at, path, query)


def canonical(df: DataFrame, col: str = "url", out: str = "canonical") -> DataFrame:
    """Adds the canonical form, without fragment; null for what isn't a URL."""
    p = parts(df, col, "_")
    made = compose(*[F.col(f"_{x}") for x in ("scheme", "host", "port", "path", "param")])
    return p.withColumn(out, made).drop(*[f"_{x}" for x in ("scheme", "host", "port", "path", "param", "fragment")])


def is_valid(url: Column) -> Column:
    """Whether a request line may hold the URL: Gemini, at most 2048 bytes, no line break, no host that ends in a dot."""
    return F.coalesce((F.octet_length(url) <= 2048) & ~url.rlike("[\r\n]") & url.rlike("^gemini://[^:/.]") & ~url.rlike("^gemini://[^:/]*[.]($|[:/])"), F.lit(False))


def authority(host: Column, port: Column) -> Column:
    return F.concat(host, F.lit(":"), F.when(port == 0, F.lit(1965)).otherwise(port).cast("string"))


def alias(host: Column, port: Column, path: Column) -> Column:
    """The host that answers for others, on the usual port."""
    moved = F.when(host.endswith(".cities.yesterweb.org") & path.startswith("/sites/"), "cities.yesterweb.org").when(host == "tuxmachines.org", "gemini.tuxmachines.org")
    return F.when(port == 1965, F.coalesce(moved, host)).otherwise(host)


def security_txt(scheme: Column, host: Column, port: Column) -> Column:
    return compose(scheme, host, port, F.lit("/.well-known/security.txt"), F.lit(""))


def page_kind(scheme: Column, path: Column, param: Column) -> Column:
    """1 for a capsule's or a user's home page, else 0."""
    return F.when((scheme == "gemini") & (param == "") & path.rlike("^/(~[^/]+)?$"), 1).otherwise(0).cast("long")


def resolve(df: DataFrame, base: str, ref: str, out: str = "resolved") -> DataFrame:
    """Adds the Gemini URL that a reference means on a page; null where it means none."""
    b = canonical(parts(df, base, "_b"), base, "_base").withColumn("_clean", F.split_part(F.col(ref), F.lit("#"), F.lit(1)))
    b = canonical(b, "_clean", "_abs")
    clean = F.col("_clean")
    dir_ = F.regexp_extract("_bpath", "^(.*/)", 1)
    own_path, own_param = F.split_part(clean, F.lit("?"), F.lit(1)), F.when(F.contains(clean, F.lit("?")), F.regexp_extract(clean, "[?](.*)$", 1)).otherwise("")
    path = fold_path(F.when(own_path.startswith("/"), own_path).when(own_path == "", F.col("_bpath")).otherwise(F.concat(dir_, own_path)))
    joined = compose(F.col("_bscheme"), F.col("_bhost"), F.col("_bport"), path, own_param)
    bad = (F.octet_length(ref) > 2048) | F.col(ref).rlike("[\r\n\\x00]")
    found = (
        F.when(bad, None)
        .when(clean == "", F.col("_base"))
        .when(F.col("_abs").isNotNull(), F.when(F.col("_abs").startswith("gemini://"), F.col("_abs")))
        .when(ascii_lower(clean).startswith("gemini://") | clean.startswith("//"), None)
        .when(clean.rlike("^[A-Za-z]*:"), None)
        .otherwise(joined)
    )
    return b.withColumn(out, found).select(*df.columns, out)


def encode_component(c: Column) -> Column:
    """Percent-encoding of all but letters, digits and -._~ ."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def archive_link(url: Column, param: Column, tail: Column | None = None) -> Column:
    """The archive's own address of a page: /archive/scheme/x/target[tail][/param/...]."""
    scheme, target = F.regexp_extract(url, "^([0-9A-Za-z]+)://", 1), F.regexp_extract(url, "^[0-9A-Za-z]+://([^?]*)", 1)
    query = F.when(param == "", F.lit("")).otherwise(F.concat(F.lit("/param/"), encode_component(param)))
    return F.concat(F.lit("/archive/"), scheme, F.lit("/x/"), encode_component(target), tail if tail is not None else F.lit(""), query)


def canonical_alias(df: DataFrame, col: str, out: str) -> DataFrame:
    """Adds the canonical Gemini URL, without fragment, of the host that answers for it; null for anything else."""
    p = parts(df, col, "_")
    host = alias(F.col("_host"), F.col("_port"), F.col("_path"))
    made = compose(F.col("_scheme"), host, F.col("_port"), F.col("_path"), F.col("_param"))
    return p.withColumn(out, F.when(F.col("_scheme") == "gemini", made)).drop(*[f"_{x}" for x in ("scheme", "host", "port", "path", "param", "fragment")])


def from_route(df: DataFrame, scheme: str, path: str, param: str, out: str = "target") -> DataFrame:
    """Adds the URL that an archive route means: percent-encoded path and param, a plus sign being a blank in neither; null where they hold what they may not."""
    decode = lambda c: F.coalesce(F.try_url_decode(F.replace(F.col(c), F.lit("+"), F.lit("%2B"))), F.lit(""))
    rows = df.withColumns({"_p": decode(path), "_q": decode(param)})
    good = (F.col(scheme) == "gemini") & (F.col("_p") != "") & ~F.col("_p").rlike("[?#\\x00]") & ~F.col("_q").rlike("[#\\x00]")
    raw = F.concat(F.lit("gemini://"), "_p", F.when(F.col("_q") == "", "").otherwise(F.concat(F.lit("?"), "_q")))
    return canonical_alias(rows.withColumn("_raw", F.when(good, raw)), "_raw", out).drop("_p", "_q", "_raw")


def seed_address(df: DataFrame, col: str) -> DataFrame:
    """Adds seed and authority of what a user asks to be fetched; null for what isn't a Gemini URL."""
    rows = canonical_alias(df.withColumn("_ok", F.when(is_valid(F.col(col)), F.col(col))), "_ok", "seed")
    return parts(rows, "seed", "_s_").withColumn("authority", authority(F.col("_s_host"), F.col("_s_port"))).select(*df.columns, "seed", "authority")
