"""URL identity: one listing, one id, however its link was decorated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.text import bind, short_sha256, strip

# --- Fixed values: parameters that say where a click came from ---
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "ref", "referrer", "source", "src", "gh_src", "lever-source",
    "gclid", "fbclid", "mc_cid", "mc_eid",
)
# --- End of fixed values -----------------------------------------

_URL = r"(?s)\A(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def _unquote(c: Column) -> Column:
    # A stray percent sign stands for itself instead of failing the decode.
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9a-fA-F]{2})", "%25"))


def _quote(c: Column) -> Column:
    # Java's encoder and RFC 3986 disagree on these two characters.
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _query(raw: Column) -> Column:
    pairs = F.filter(F.split(raw, "&"), lambda p: F.regexp_like(p, F.lit("(?s)=.")))
    decoded = F.transform(
        pairs,
        lambda p: F.struct(
            _unquote(F.substring_index(p, "=", 1)).alias("k"),
            _unquote(F.regexp_replace(p, r"(?s)\A[^=]*=", "")).alias("v"),
        ),
    )
    kept = F.filter(decoded, lambda kv: ~F.lower(kv["k"]).isin(*TRACKING_PARAMS))
    encoded = F.transform(F.array_sort(kept), lambda kv: F.concat(_quote(kv["k"]), F.lit("="), _quote(kv["v"])))
    return F.array_join(encoded, "&")


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no tracking, sorted query.

    The path keeps its case. A host with unbalanced brackets gives null.
    """
    clean = F.regexp_replace(strip(url), r"[\t\r\n]", "")
    host = F.lower(_part(clean, 2))
    path = F.regexp_replace(_part(clean, 3), r"/+\z", "")
    query = F.when(clean.contains("?"), _query(_part(clean, 4))).otherwise(F.lit(""))
    scheme = F.lower(_part(clean, 1))
    broken = host.contains("[") != host.contains("]")
    return F.when(
        ~broken,
        F.concat(
            F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
            F.when(host != "", F.concat(F.lit("//"), host)).otherwise(F.lit("")),
            F.when(path == "", F.lit("/")).otherwise(path),
            bind(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))),
        ),
    )


def listing_id(canonical: Column) -> Column:
    return short_sha256(canonical)


def is_web_url(canonical: Column) -> Column:
    """True for an http(s) URL that names a host; null counts as false."""
    return F.coalesce(canonical.rlike(r"\Ahttps?://[^/]"), F.lit(False))
