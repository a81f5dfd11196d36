"""URL measures and destination flags."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Registrable hosts of the two known destinations.
LEAK_HOSTS = ("wikileaks.org",)
DROPBOX_HOSTS = ("dropbox.com", "dropboxusercontent.com", "dropboxstatic.com")


def url_length(url: Column) -> Column:
    return F.coalesce(F.length(url), F.lit(0))


# scheme, then the authority up to the path: user info and port are no part of the host, which
# ends at the first character that no host has.
_AUTHORITY = r"""^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@\s"'<>]*@)?(\[[^\]/?#]*\]|[^/?#:\s"'<>|{}\\^`]*)"""
_PATH = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def url_depth(url: Column) -> Column:
    """Number of non-empty path segments, whatever characters the path has."""
    path = F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))
    return F.size(F.filter(F.split(path, "/"), lambda s: s != ""))


def host(url: Column) -> Column:
    """The host in lower case, NULL where there is none.

    Proxy logs hold URLs that no strict parser takes (bars, braces, quotes, spaces, underscores
    in the host), so only what bounds the authority is looked for.
    """
    found = F.lower(F.trim(F.regexp_extract(url, _AUTHORITY, 1)))
    return F.when(found != "", found)


def registrable(host_name: Column) -> Column:
    """The last two labels of a host; a host of one label stays as it is."""
    return F.substring_index(host_name, ".", -2)


def url_pattern() -> str:
    return r"(?i)(https?://\S+)"


def among(registrable_host: Column, hosts: Iterable[str]) -> Column:
    hosts = list(hosts)
    if not hosts:
        return F.lit(False)
    return F.coalesce(registrable_host.isin(*hosts), F.lit(False))


def in_hosts(url: Column, hosts: Iterable[str]) -> Column:
    return among(registrable(host(url)), hosts)
