"""Addresses and identities of resources as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that are dropped from addresses.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "ref"]


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$", group)


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case without `www.`, no tracking or blank parameters, no fragment, no trailing slash;
    parameters of one name stand together where the name came first. What is no address with a host is null."""
    path = _part(url, 3)
    kept = F.filter(F.split(_part(url, 4), "&"), lambda p: p.rlike("^[^=]+=.") & ~F.substring_index(p, "=", 1).isin(TRACKING))
    names = F.array_distinct(F.transform(kept, lambda p: F.substring_index(p, "=", 1)))
    query = F.array_join(F.flatten(F.transform(names, lambda n: F.filter(kept, lambda p: F.substring_index(p, "=", 1) == n))), "&")
    trimmed = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    host = F.regexp_replace(F.lower(_part(url, 2)), r"^www\.", "")
    return F.when(_part(url, 2) != "", F.concat(F.lower(_part(url, 1)), F.lit("://"), host, trimmed, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def domain(url: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(_part(url, 2)), r"^www\.", ""), F.lit(""))


def video_id(url: Column) -> Column:
    """Eleven characters from a watch, short or embed address."""
    none = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(none(F.regexp_extract(url, r"[?&]v=([A-Za-z0-9_-]{11})", 1)), none(F.regexp_extract(url, r"/embed/([A-Za-z0-9_-]{11})", 1)),
                      none(F.regexp_extract(url, r"^[a-z]+://(?:youtu\.be|tube\.invalid)/([A-Za-z0-9_-]{11})", 1)))


def url_seconds(url: Column) -> Column:
    """The `t` or `start` parameter in whole seconds, a trailing s allowed; else null."""
    value = lambda p: F.regexp_replace(F.regexp_extract(url, rf"[?&]{p}=([^&#]*)", 1), "s+$", "")
    whole = lambda v: F.when(v.rlike("^[0-9]+$"), v.cast("int"))
    return F.coalesce(whole(value("t")), whole(value("start")))


def canonical_id(source_type: Column, url: Column, content_hash: Column) -> Column:
    """`youtube:` with the video, `webpage:` with the digest of the address, else the type with the digest of the file."""
    kind = F.when(source_type.isin("local_audio", "local_video"), "media").when(source_type == "local_transcript", "transcript").otherwise(source_type)
    return (F.when((source_type == "youtube") & video_id(url).isNotNull(), F.concat(F.lit("youtube:"), video_id(url)))
            .when(source_type.isin("youtube", "webpage"), F.concat(F.lit("webpage:"), F.sha2(normalize_url(url), 256)))
            .otherwise(F.concat(kind, F.lit(":"), content_hash)))
