"""Site names of links. Three normalisations exist side by side because later stages depend on their differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^[a-z][a-z0-9+.\-]*://"


def _host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), SCHEME + r"([^/?#]*)", 1)


def _with_scheme(url: Column, scheme: str) -> Column:
    return F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit(scheme), url))


def _no_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def report_domain(url: Column) -> Column:
    """For coverage reports: a missing scheme is added, port and user stay, nothing found is `missing`."""
    u = F.trim(F.coalesce(url, F.lit("")))
    host = _no_www(_host(_with_scheme(u, "http://")))
    return F.when((u == "") | (host == ""), "missing").otherwise(host)


def temporal_domain(url: Column) -> Column:
    """For temporal profiles: links without a scheme have no site; user and port are stripped."""
    host = F.regexp_replace(F.regexp_replace(_host(F.trim(F.coalesce(url, F.lit("")))), r"^.*@", ""), r":.*$", "")
    host = _no_www(host)
    return F.when(host == "", "unknown_domain").otherwise(host)


def serving_domain(url: Column) -> Column:
    """For display: a missing scheme is added, port and user stay, nothing found is empty."""
    u = F.trim(F.coalesce(url, F.lit("")))
    return F.when(u == "", "").otherwise(_no_www(_host(_with_scheme(u, "https://"))))


def unquote(url: Column) -> Column:
    """Percent-decoding; a plus sign stays, and text that cannot be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def query_map(query: Column) -> Column:
    """Parameters of a query string by lower-case name (the last value of a repeated name)."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    entry = lambda p: F.struct(F.lower(F.substring_index(p, "=", 1)).alias("key"), F.regexp_replace(p, "^[^=]*=?", "").alias("value"))
    entries = F.transform(pairs, entry)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)
