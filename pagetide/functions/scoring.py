"""Scores of links: sums of weights of the keywords that text or URL hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import any_of, host, is_external, is_generic_portal
from .vocabulary import ELECTION_LABELS, EXTERNAL_PENALTY, FIRST_WEIGHTS, GENERIC_PORTALS, LINK_WEIGHTS, MINIMUM, SKIP_LINKS


def is_page_link(href: Column, url: Column) -> Column:
    """Whether a link may lead to a page worth a capture: no chrome, no PDF, over http, no statewide portal."""
    low = F.lower(F.trim(href))
    return (low != "") & ~low.rlike(any_of(SKIP_LINKS)) & ~low.endswith(".pdf") & url.startswith("http") & ~F.lower(url).rlike(any_of(GENERIC_PORTALS))


def is_plain_link(href: Column, url: Column) -> Column:
    """The milder filter of the first batch."""
    h = F.trim(href)
    return (h != "") & ~h.rlike("^(#|mailto:|tel:|javascript:)") & url.startswith("http")


def keyword_score(text: Column, url: Column, weights: list[tuple[str, int]]) -> Column:
    """A keyword in the text counts whole; else, in the URL, a good one by half, rounded down, at least 1."""
    t, u = F.lower(text), F.regexp_replace(F.lower(url), "[-_/]", " ")
    total = F.lit(0)
    for word, w in weights:
        total = total + F.when(t.contains(word), w).when(u.contains(word), max(1, w // 2) if w > 0 else w).otherwise(0)
    return total


def link_score(text: Column, url: Column, page_type: str) -> Column:
    """For elections, an exact label and a host of its own count on top."""
    s = keyword_score(text, url, LINK_WEIGHTS[page_type])
    if page_type == "elections":
        label = F.split(F.regexp_replace(host(url), r"^www\.", ""), r"\.")[0]
        s = s + F.when(F.trim(F.lower(text)).isin(ELECTION_LABELS), 8).otherwise(0) + F.when(label.contains("vote") | (label == "elections"), 12).otherwise(0)
    return s


def first_score(text: Column, url: Column, page_type: str) -> Column:
    """The first batch's: every keyword in text and URL together counts whole."""
    both = F.lower(F.concat_ws(" ", text, url))
    total = F.lit(0)
    for word, w in FIRST_WEIGHTS[page_type]:
        total = total + F.when(both.contains(word), w).otherwise(0)
    return total


def internal_first(score: Column, url: Column, home: Column, page_type: str) -> Column:
    """A little less for links that leave the county's site; null if nothing is left of it."""
    less = score - F.when(is_external(url, home), EXTERNAL_PENALTY.get(page_type, 0)).otherwise(0)
    return F.when((score > 0) & (less > 0), less)


def weak_note(score: Column, page_type: Column) -> Column:
    least = F.coalesce(*[F.when(page_type == k, v) for k, v in MINIMUM.items()])
    return F.when(score < least, F.lit("(weak match — review)")).otherwise(F.lit(""))


__all__ = ["first_score", "internal_first", "is_generic_portal", "is_page_link", "is_plain_link", "keyword_score", "link_score", "weak_note"]
