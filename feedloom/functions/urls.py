"""http(s) URLs by the public URL standard, as far as regular expressions go.

Underscores, non-ASCII hosts, blanks and braces in paths and queries are valid. Not done: Punycode of
non-ASCII hosts and number forms of IPv4 addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the URL standard: code points that no host may hold, and the ports that are left out.
HOST = r"\[[0-9A-Fa-f:.]+\]|(?:[^\x00-\x20#/:<>?@\[\\\]^|%\x7F]|%[0-9A-Fa-f]{2})+"
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
_WEB = rf"(?is)^(https?|ftp|wss?):[/\\]*(?:[^/\\?#]*@)?({HOST})(?::([0-9]*))?([/\\][^?#]*)?(?:(\?)([^#]*))?(?:(#)(.*))?\z"
_ANY = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):(?:.+)\z"


def _clean(url: Column) -> Column:
    """Control characters and blanks at the ends go, tabs and line ends everywhere."""
    return F.regexp_replace(F.translate(url, "\t\n\r", ""), r"^[\x00-\x20]+|[\x00-\x20]+\z", "")


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(_clean(url), _WEB, k)


def scheme(url: Column) -> Column:
    """Lower-case scheme of anything that has one; NULL otherwise."""
    s = F.regexp_extract(_clean(url), _ANY, 1)
    return F.when(s != "", F.lower(s))


def _valid(url: Column) -> Column:
    """A URL of the schemes above with a host and a port of at most 65535; NULL is none."""
    port = F.when(_part(url, 3) != "", _part(url, 3).try_cast("int")).otherwise(0)
    return F.coalesce(_clean(url).rlike(_WEB) & F.coalesce(port <= 65535, F.lit(False)), F.lit(False))


def is_http_url(url: Column) -> Column:
    """A valid URL whose scheme is http or https (any case)."""
    return _valid(url) & F.coalesce(scheme(url).isin("http", "https"), F.lit(False))


def host(url: Column) -> Column:
    return F.when(_valid(url), F.lower(_part(url, 2)))


def query(url: Column) -> Column:
    """The query without its mark; empty when there is none."""
    return _part(url, 6)


def fragment(url: Column) -> Column:
    return _part(url, 8)


def _escaped(text: Column, extra: str) -> Column:
    for c in ' "<>' + extra:
        text = F.replace(text, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return text


def path(url: Column) -> Column:
    """The path with dot segments resolved; ``/`` when there is none."""
    segments = F.split(F.regexp_replace(F.regexp_replace(_part(url, 4), r"\\", "/"), r"^/", ""), "/", -1)
    lower = lambda s: F.replace(F.lower(s), F.lit("%2e"), F.lit("."))
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda done, s: F.when(lower(s) == ".", done)
        .when(lower(s) == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(s))))
    dir_end = lower(F.element_at(segments, -1)).isin(".", "..")  # a dot segment at the end leaves a slash
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(dir_end & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))
    return _escaped(joined, "`{}")


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no user, no default port, resolved path, query and fragment kept; NULL when invalid."""
    proto = F.lower(_part(url, 1))
    port = F.regexp_replace(_part(url, 3), "^0+(?=[0-9])", "")
    usual = F.element_at(F.create_map(*[F.lit(x) for kv in DEFAULT_PORTS.items() for x in kv]), proto)
    text = F.concat(proto, F.lit("://"), host(url),
                    F.when((port != "") & (port != usual), F.concat(F.lit(":"), port)).otherwise(F.lit("")), path(url),
                    F.when(_part(url, 5) != "", F.concat(F.lit("?"), _escaped(query(url), "'"))).otherwise(F.lit("")),
                    F.when(_part(url, 7) != "", F.concat(F.lit("#"), _escaped(fragment(url), "`"))).otherwise(F.lit("")))
    return F.when(_valid(url), text)
