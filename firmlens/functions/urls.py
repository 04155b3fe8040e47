"""Web address parts, checks and normal forms as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what a domain name may look like.
DOMAIN_RULE = (r"^[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?"
               r"(\.[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?)*$")


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)


def authority(url: Column) -> Column:
    """Host with port, as written."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Host with port, without any ``www.``."""
    return F.replace(authority(url), F.lit("www."), F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def site(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def robots_address(url: Column) -> Column:
    return F.concat(site(url), F.lit("/robots.txt"))


def is_web_address(url: Column) -> Column:
    return scheme(url).isin("http", "https") & (F.length(authority(url)) > 0)


def is_result_address(url: Column) -> Column:
    """Address acceptable as a search result."""
    return is_web_address(url) & (F.length(url) > 10)


def is_valid_result(title: Column, url: Column) -> Column:
    return F.coalesce((F.length(title) > 0) & (F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://")))
                      & (F.length(F.trim(title)) >= 3), F.lit(False))


def with_scheme(url: Column) -> Column:
    u = F.trim(url)
    return (F.when(u.isNull() | (u == ""), "")
            .when(u.startswith("http://") | u.startswith("https://"), u).otherwise(F.concat(F.lit("https://"), u)))


def normal_domain(domain: Column) -> Column:
    d = F.lower(F.trim(domain))
    d = F.regexp_replace(F.regexp_replace(d, r"^https?://", ""), r"^www\.", "")
    return F.regexp_replace(d, "/+$", "")


def is_domain(domain: Column) -> Column:
    d = normal_domain(domain)
    return d.rlike(DOMAIN_RULE) & (F.length(d) <= 253)


def quoted(text: Column) -> Column:
    """Percent-encoding that leaves ``/`` alone and writes blanks as ``%20``."""
    enc = F.url_encode(text)
    for find, put in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        enc = F.replace(enc, F.lit(find), F.lit(put))
    return enc
