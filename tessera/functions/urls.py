"""Repair and comparison of urls as models write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import fuzzy

#: Endings that are cut from a host, in this order.
HOST_RULES = [
    (r"\.com-([a-z]+)$", ".com"),
    (r"\.net-([a-z]+)$", ".net"),
    (r"\.org-([a-z]+)$", ".org"),
    (r"\.edu-([a-z]+)$", ".edu"),
    (r"\.gov-([a-z]+)$", ".gov"),
    (r"\.([a-z]+)-([a-z]+)$", ".$1"),
    (r"-([a-z]+)$", ""),
]
#: Scheme, host, path, query and fragment after the generic syntax of RFC 3986.
GENERIC = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def normal_host(host: Column) -> Column:
    for pattern, to in HOST_RULES:
        host = F.regexp_replace(host, pattern, to)
    return host


def normal_path(path: Column) -> Column:
    once = F.regexp_replace(path, "/+", "/")
    return F.when(once.startswith("/"), once).otherwise(F.concat(F.lit("/"), once))


def unmerged(url: Column) -> Column:
    """host-segment/rest, with a path segment stuck to the host, becomes https://host/segment/rest."""
    return F.regexp_replace(url, "^https?://([^/]+)-([a-z]+)/(.+)", "https://$1/$2/$3")


def part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, GENERIC, i)


def normal_url(url: Column) -> Column:
    fixed = unmerged(url)
    scheme, host, path, query, fragment = (part(fixed, i) for i in range(1, 6))
    tail = F.concat(F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))
    return F.concat(F.when(scheme != "", F.lower(scheme)).otherwise("https"), F.lit("://"), normal_host(host), normal_path(path), tail)


def same_page(a: Column, b: Column) -> Column:
    """Equal after repair, or of the same host and path."""
    x, y = normal_url(a), normal_url(b)
    return (x == y) | ((part(x, 2) == part(y, 2)) & (part(x, 3) == part(y, 3)))


def similar_pages(a: Column, b: Column, threshold: float = 0.9) -> Column:
    """same_page, or repaired urls whose Ratcliff-Obershelp ratio is threshold at least; null urls are similar to none.

    Only pairs whose lengths allow the ratio are compared.
    """
    x, y = normal_url(a), normal_url(b)
    close = F.when(fuzzy.may_reach(x, y, 100 * threshold), fuzzy.ratio(x, y)).otherwise(0.0) >= 100 * threshold
    return F.coalesce(same_page(a, b) | close, F.lit(False))


def host_of(url: Column) -> Column:
    return F.when(url.startswith("http"), F.regexp_extract(url, "^https?://([^/?#]*)", 1)).otherwise(url)
