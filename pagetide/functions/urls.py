"""URLs: parts, sites, laundered and volatile forms, candidates."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import EPOCH, GUID, LONG_HEX, hyphened, squashed
from .vocabulary import BAD_HOSTS, CACHE_PARAMETERS, CANDIDATE_HOSTS, GENERIC_PORTALS


def any_of(words: list[str]) -> str:
    """A pattern of words that stand for themselves."""
    return "|".join(re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", w) for w in words)


def host(url: Column) -> Column:
    """Lower-case host and port; empty without one."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def registered_domain(url: Column) -> Column:
    """The last two labels of the host; three if the whole URL ends in .tx.us (and not with a slash behind it)."""
    labels = F.split(F.regexp_replace(host(url), r":\d+$", ""), r"\.")
    n = F.when(url.endswith(".tx.us"), 3).otherwise(2)
    return F.array_join(F.slice(labels, -F.least(n, F.size(labels)), F.least(n, F.size(labels))), ".")


def is_external(url: Column, home: Column) -> Column:
    return registered_domain(url) != registered_domain(home)


def host_differs(url: Column, home: Column) -> Column:
    return host(url) != host(home)


def is_generic_portal(url: Column) -> Column:
    """A statewide or vendor site, also behind a translation proxy whose host has dashes for dots."""
    pattern = any_of(GENERIC_PORTALS)
    return F.lower(url).rlike(pattern) | F.replace(host(url), F.lit("-"), F.lit(".")).rlike(pattern)


def is_bad_host(url: Column) -> Column:
    return host(url).rlike(any_of(BAD_HOSTS))


def unlaunder(url: Column) -> Column:
    """The page behind a translation proxy: dots for dashes, no _x_tr_ parameters, https, no fragment. Others stay as they are."""
    real = F.replace(F.regexp_replace(host(url), r"\.translate\.goog$", ""), F.lit("-"), F.lit("."))
    left = F.array_join(F.filter(F.split(query(url), "&"), lambda x: ~x.startswith("_x_tr_") & (x != "")), "&")
    out = F.concat(F.lit("https://"), real, path(url), F.when(left != "", F.concat(F.lit("?"), left)).otherwise(F.lit("")))
    return F.when(host(url).endswith(".translate.goog"), out).otherwise(url)


def stabilized(url: Column) -> Column:
    """unlaunder(), then the county's index in place of a deep link into a results application."""
    real = unlaunder(url)
    index = F.regexp_extract(real, r"(?i)^(https?://results\.enr\.clarityelections\.com/+[A-Za-z]{2}/+[^/?#]+/)", 1)
    return F.when(index != "", index).otherwise(real)


#: Values of parameters that change by themselves.
VOLATILE_VALUES = [GUID, LONG_HEX, EPOCH]


def strip_cachebust(url: Column) -> Column:
    """Without parameters that only bust caches or carry session tokens; without any if most are of that kind.

    No query, or no name in it: unchanged. Else the fragment goes, and values are decoded and encoded again.
    """
    whole = F.regexp_extract(url, r"^([^?#]*)", 1)
    pairs = F.filter(F.split(query(url), "&"), lambda x: x != "")
    named = F.transform(pairs, lambda x: F.struct(F.url_decode(F.split(x, "=", 2)[0]).alias("k"), F.coalesce(F.url_decode(F.get(F.split(x, "=", 2), F.lit(1))), F.lit("")).alias("v")))
    # Java's word boundaries see Unicode letters, like the values' own
    kept = F.filter(named, lambda p: ~F.lower(p["k"]).isin(CACHE_PARAMETERS) & ~reduce(lambda a, b: a | b, [F.trim(p["v"]).rlike(v) for v in VOLATILE_VALUES]))
    text = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    out = F.when((F.size(kept) * 2 < F.size(named)) | (F.size(kept) == 0), whole).otherwise(F.concat(whole, F.lit("?"), text))
    return F.when(~url.contains("?") | (F.size(pairs) == 0), url).otherwise(out)


def stable_query(url: str) -> str:
    """strip_cachebust() for the cleaning helper."""
    bare = url.partition("#")[0]
    address, _, query_ = bare.partition("?")
    pairs = parse_qsl(query_, keep_blank_values=True)
    stays = [not (k.lower() in CACHE_PARAMETERS or any(v.search(value.strip()) for v in PATTERNS)) for k, value in pairs]
    if not pairs:
        return url
    left = [p for p, s in zip(pairs, stays, strict=True) if s]
    return f"{address}?{urlencode(left)}" if left and sum(stays) * 2 >= len(pairs) else address


PATTERNS = [re.compile(v) for v in VOLATILE_VALUES]


def squeezed(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[\s_-]", "")


def plausible_target(url: Column, county: Column, home: Column, elections: Column) -> Column:
    """On the county's site, on that of its elections page, or with the county's name in the URL."""
    named = F.regexp_replace(F.lower(url), "[^a-z0-9]", "").contains(squashed(county))
    return ~is_external(url, home) | F.coalesce(~is_external(url, elections) & (elections != ""), F.lit(False)) | named


def redirected_to_root(requested: Column, final: Column) -> Column:
    """A page of a site that now leads to the site's first page."""
    a, b = F.regexp_replace(path(requested), "/+$", ""), F.regexp_replace(path(final), "/+$", "")
    return (F.length(a) > 1) & (a != b) & (b == "")


def candidate_urls(county: Column) -> Column:
    """Likely homepages in order of priority; hosts with hyphens only for names of several words."""
    s, h = squashed(county), hyphened(county)
    urls = []
    for x in CANDIDATE_HOSTS:
        before, rest = x.split("{")
        which, after = rest.split("}")
        url = F.concat(F.lit(f"https://{before}"), s if which == "squashed" else h, F.lit(f"{after}/"))
        urls.append(url if which == "squashed" else F.when(h != s, url))
    return F.array_compact(F.array(*urls))


def redirect_chain(requested: Column, final: Column) -> Column:
    return F.array_compact(F.array_distinct(F.array(requested, final)))
