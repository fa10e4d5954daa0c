"""Canonical URLs: the identity of a summary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that say nothing about the content.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "mc_eid")


def ascii_host(host: Column) -> Column:
    """A host with its non-ASCII labels in Punycode (IDNA), user and port left alone; as it is if a label can't be told so."""
    part = lambda i: F.regexp_extract(host, r"^([^@]*@)?([^:]*)(.*)$", i)
    told = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), part(2))
    return F.when(host.rlike(r"[^\x00-\x7F]"), F.coalesce(F.concat(part(1), F.lower(told), part(3)), host)).otherwise(host)


def canonical(url: Column) -> Column:
    """Lower-case scheme and host (in its ASCII form), no tracking parameters, fragment or closing slash; video and code hosts by their own rules.

    A blank is null; what has no scheme and no dot before its first slash is kept as it is.
    """
    raw = F.trim(url)
    bare = ~raw.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    host_like = ~raw.startswith("/") & F.substring_index(raw, "/", 1).contains(".")
    full = F.when(bare & host_like, F.concat(F.lit("https://"), raw)).otherwise(raw)
    part = lambda i: F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", i)
    scheme, host, path, query = F.lower(part(1)), ascii_host(F.lower(part(2))), part(3), part(4)
    pairs = F.filter(F.split(query, "&"), lambda p: p.contains("=") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING) & (F.substring_index(p, "=", -1) != ""))
    kept = F.array_join(pairs, "&")
    plain = F.regexp_replace(path, "/+$", "")
    general = F.concat(scheme, F.lit("://"), host, F.when(plain == "", "/").otherwise(plain), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    video = F.regexp_extract(path, r"^/(?:shorts|embed)/([^/?]+)", 1)
    own = F.array_join(F.filter(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1).isin("v", "list", "index", "t") & (F.substring_index(p, "=", -1) != "")), "&")
    watch = F.when(video != "", F.concat(F.lit("https://www.youtube.com/watch?v="), video)).otherwise(
        F.concat(scheme, F.lit("://www.youtube.com"), path, F.when(own != "", F.concat(F.lit("?"), own)).otherwise(""))
    )
    code = F.concat(F.lit("https://github.com"), F.regexp_replace(F.regexp_replace(F.lower(path), "/+$", ""), r"\.git$", ""))
    return (
        F.when((raw == "") | raw.isNull(), F.lit(None)).when(bare & ~host_like, raw)
        .when(host == "youtu.be", F.concat(F.lit("https://www.youtube.com/watch?v="), F.regexp_replace(path, "^/+", "")))
        .when((host == "youtube.com") | host.endswith(".youtube.com"), watch)
        .when((host == "github.com") | host.endswith(".github.com"), code).otherwise(general)
    )
