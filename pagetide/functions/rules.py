"""Decisions about captures and pages: liveness, identity, audit. First rule that holds decides.

Fixed values here: the texts of errors, reasons and evidence, and the thresholds in the rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import host, redirected_to_root, squeezed
from .vocabulary import BAD_PAGE, COMMERCIAL, ERROR_PAGE, GOV, INTERSTITIAL, JS_SHELL, NON_GOV, NON_GOV_TITLE, PARKED, STRONG, WEAK

DASH = "—"


def parse_external(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("true", "1", "yes")


def is_html(content_type: Column) -> Column:
    """Unknown types pass."""
    return F.coalesce(content_type, F.lit("")).eqNullSafe("") | F.lower(content_type).rlike("html|xml|text/plain")


def bound(value: Column, then) -> Column:
    """then(value), with the value computed once however often it stands there."""
    return F.transform(F.array(value), then)[0]


def holds_any(text: Column, words: list[str]) -> Column:
    return bound(text, lambda t: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w)))


def is_js_shell(text: Column, html: Column, min_chars: int = 500) -> Column:
    marked = [holds_any(F.lower(F.coalesce(c, F.lit(""))), JS_SHELL) for c in (text, html)]
    return (F.length(stripped(text)) < min_chars) | marked[0] | marked[1]


def is_interstitial(html: Column) -> Column:
    return holds_any(F.lower(F.substring(F.coalesce(html, F.lit("")), 1, 6000)), INTERSTITIAL)


def stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def needs_render(ok: Column, content_type: Column, text: Column, clean: Column, raw: Column) -> Column:
    return is_html(content_type) & (~ok | is_js_shell(text, clean) | is_interstitial(raw))


def few_links(ok: Column, status: Column, html: Column) -> Column:
    """Discovery renders pages that fail or hold fewer than five links."""
    return ~ok | (F.coalesce(status, F.lit(0)) >= 400) | (F.regexp_count(F.lower(html), F.lit(r"<a\s[^>]*href=")) < 5)


def error_label(error: Column, html: Column, content_type: Column, render_error: Column, clean_text: Column, clean_html: Column) -> Column:
    first = F.coalesce(error, F.when(~is_html(content_type), F.concat(F.lit("non_html_content: "), content_type)), render_error)
    challenged = (F.coalesce(clean_text, F.lit("")) != "") & is_interstitial(clean_html)
    return F.when(challenged, F.concat_ws("; ", F.lit("bot_challenge_not_cleared: page shows a bot check"), first)).otherwise(first)


def usable(error: Column) -> Column:
    """The error alone decides: a status of 202, or of 403 once the check is passed, may come with the page."""
    return error.isNull()


def hits(text: Column, words: list[str]) -> Column:
    """Those of the words that the text holds, in their order."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words]))


def hits_for(text: Column, page_type: Column, words: dict[str, list[str]]) -> Column:
    out = F.array().cast("array<string>")
    for k, v in words.items():
        out = F.when(page_type == k, hits(text, v)).otherwise(out)
    return out


def liveness(url: Column, ok: Column, error: Column, content_type: Column, status: Column) -> Column:
    """struct(status, confidence, reason); reason is null for pages that are there."""
    def told(status_, confidence, reason):
        return F.struct(F.lit(status_).alias("status"), F.lit(confidence).alias("confidence"), reason.alias("reason"))

    return (
        F.when(F.trim(url) == "", told("gap", "gap", F.lit("")))
        .when(error.isNotNull() & ~ok, told("broken", "broken", F.concat(F.lit("fetch failed: "), F.substring(error, 1, 90))))
        .when(ok & ~is_html(content_type), told("broken", "uncertain", F.concat(F.lit("non-HTML content ("), content_type, F.lit(f") {DASH} out of scope"))))
        .when(status >= 400, told("broken", "broken", F.concat(F.lit("HTTP "), status.cast("string"))))
        .otherwise(told("ok", None, F.lit(None).cast("string")))
    )


def audit_content(county: Column, seat: Column, page_type: Column, text: Column, title: Column, final_url: Column, requested: Column) -> Column:
    """struct(confidence, reason, flag) of a page that is there. A county without a seat has an empty one."""
    t = F.coalesce(title, F.lit(""))
    found = bound(F.lower(F.concat(t, F.lit("\n"), text)), lambda hay: F.struct(
        F.contains(hay, F.lower(county)).alias("in_text"), ((seat != "") & F.contains(hay, F.lower(seat))).alias("seat_in"),
        hits_for(hay, page_type, STRONG).alias("strong"), hits_for(hay, page_type, WEAK).alias("weak"), hits(hay, BAD_PAGE).alias("bad")))
    return bound(found, lambda f: _audited(f, county, seat, page_type, text, t, final_url, requested))


def _audited(found: Column, county: Column, seat: Column, page_type: Column, text: Column, t: Column, final_url: Column, requested: Column) -> Column:
    in_text, seat_in, strong, weak, bad = (found[k] for k in ("in_text", "seat_in", "strong", "weak", "bad"))
    in_url = F.contains(squeezed(final_url), squeezed(county))
    identity = in_text | in_url | (seat_in & (page_type != "homepage"))
    root = redirected_to_root(requested, final_url)
    some = lambda c: F.size(c) > 0
    first = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    who = F.concat_ws("; ", F.when(in_text, F.concat(F.lit("county name '"), county, F.lit("' in page"))).when(in_url, F.concat(F.lit("'"), county, F.lit("' in domain"))), F.when(seat_in, F.concat(F.lit("seat '"), seat, F.lit("' in page"))))
    parts = F.concat_ws(
        " | ",
        F.when(who != "", who),
        F.when(some(strong), F.concat(page_type, F.lit(" keywords: "), first(strong, 4))).when(some(weak), F.concat(F.lit("weak "), page_type, F.lit(" keywords: "), first(weak, 3))),
        F.when(t != "", F.concat(F.lit('title="'), F.substring(t, 1, 70), F.lit('"'))),
    )
    reason = F.when(parts != "", parts).otherwise(F.lit("no identity or topic keywords found"))
    confidence = F.when(some(bad) | root, "uncertain").when(identity & some(strong), "confident").when(identity & (some(weak) | (page_type == "homepage")), "likely").otherwise("uncertain")
    said = (
        F.when(some(bad), F.concat(F.lit("POSSIBLE ERROR PAGE ("), first(bad, 2), F.lit("); "), reason))
        .when(root, F.concat(F.lit("requested deep path redirected to site root ("), final_url, F.lit("); "), reason))
        .when((confidence == "uncertain") & (identity | some(strong)), F.concat(F.lit(f"only partial match {DASH} "), reason))
        .otherwise(reason)
    )
    n = F.length(stripped(text))
    thin = (n < 200) & ~some(bad)
    return F.struct(
        F.when(thin & (confidence == "confident"), "likely").otherwise(confidence).alias("confidence"),
        F.when(thin, F.concat(F.lit("thin content ("), n.cast("string"), F.lit(" chars); "), said)).otherwise(said).alias("reason"),
        ((confidence == "uncertain") | (thin & (confidence != "confident"))).alias("flag"),
    )


def quoted(name: Column) -> Column:
    """A name as a pattern that stands for itself."""
    return F.regexp_replace(F.lower(name), r"([^a-z0-9 ])", r"\\\\$1")


def verify(county: Column, seat: Column, url: Column, text: Column, title: Column, others_in_title: Column) -> Column:
    """struct(confidence, evidence): whether a page is that of the county's government.

    others_in_title: other counties that the title names (operators.discovery.other_counties).
    """
    title_l = F.lower(F.coalesce(title, F.lit("")))
    name = quoted(county)

    def signals(hay):
        # a name is looked for before its pattern is
        named = F.regexp_like(hay, F.concat(F.lit(r"(?U)\b"), name, F.lit(r"\b\s*'?s?\s+county\b"))) | F.regexp_like(hay, F.concat(F.lit(r"(?U)\bcounty\s+of\s+"), name, F.lit(r"\b")))
        seated = F.regexp_like(hay, F.concat(F.lit(r"(?U)\b"), quoted(seat), F.lit(r"\b")))
        return F.struct(
            hits(hay, GOV).alias("gov"), hits(hay, COMMERCIAL).alias("commercial"), hits(hay, NON_GOV).alias("other_org"), bound(F.substring(hay, 1, 4000), lambda h: hits(h, PARKED)).alias("parked"),
            bound(F.substring(hay, 1, 2000), lambda h: hits(h, ERROR_PAGE)).alias("errors"), (F.contains(hay, F.lower(county)) & F.contains(hay, F.lit("county")) & named).alias("named"),
            (F.contains(hay, F.lit("texas")) | F.contains(hay, F.lit("tx")) & hay.rlike(r"(?U)\btx\b")).alias("state"), (F.contains(hay, F.lower(seat)) & seated).alias("seated"),
            hits(title_l, NON_GOV_TITLE).alias("title_org"), hits(title_l, PARKED).alias("title_parked"), F.length(stripped(text)).alias("n"),
        )

    hay = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), text))
    return bound(bound(hay, signals), lambda s: _verified(s, county, seat, url, others_in_title))


def _verified(found: Column, county: Column, seat: Column, url: Column, others_in_title: Column) -> Column:
    gov, commercial, other_org, title_org, parked, n, named, state, seated = (found[k] for k in ("gov", "commercial", "other_org", "title_org", "parked", "n", "named", "state", "seated"))
    site = F.regexp_replace(host(url), r":\d+$", "")
    official = site.endswith(".tx.us") | site.endswith(".gov")
    some = lambda c: F.size(c) > 0
    first = lambda c, k: F.array_join(F.slice(c, 1, k), ", ")
    labels = F.split(site, r"\.")
    evidence = F.concat_ws(
        "; ",
        F.when(named, F.concat(F.lit("'"), county, F.lit("' in page"))),
        F.when(seated, F.concat(F.lit("seat '"), seat, F.lit("' in page"))),
        F.when(state, F.lit("Texas/TX present")),
        F.when(official, F.concat(F.lit("official TLD ("), F.array_join(F.slice(labels, -2, 2), "."), F.lit(")"))),
        F.when(some(gov), F.concat(F.lit("gov signals: "), first(gov, 3))),
    )
    evidence = F.when(evidence != "", evidence).otherwise(F.lit("no signals"))

    def told(confidence, why):
        return F.struct(F.lit(confidence).alias("confidence"), why.alias("evidence"))

    tail = F.concat(F.lit(f" {DASH} "), evidence)
    why_org = F.when(some(title_org), title_org).otherwise(other_org)
    return (
        F.when(some(parked) & (some(found["title_parked"]) | ((n < 800) & ~some(gov))), told("reject", F.concat(F.lit("parked/placeholder domain ("), parked[0], F.lit(")"))))
        .when(some(found["errors"]), told("reject", F.lit("error page")))
        .when(n < 120, told("reject", F.concat(F.lit("near-empty page ("), n.cast("string"), F.lit(" chars)"))))
        .when(some(commercial) & (F.size(gov) < 2), told("reject", F.concat(F.lit("commercial site ("), commercial[0], F.lit(")"), tail)))
        .when(some(title_org) | ((F.size(other_org) >= 3) & (F.size(other_org) > F.size(gov))), told("reject", F.concat(F.lit(f"not the county government {DASH} looks like a tourism/EDC/chamber site ("), first(why_org, 2), F.lit(")"), tail)))
        .when(~named, told("reject", F.concat(F.lit("page does not identify as '"), county, F.lit(" County'"), tail)))
        .when(some(others_in_title), told("reject", F.concat(F.lit("title identifies another county ("), first(F.array_sort(others_in_title), 2), F.lit(")"), tail)))
        .when(~(state | seated), told("reject", F.concat(F.lit("no Texas/seat signal (possible wrong-state county)"), tail)))
        .when(official | ((F.size(gov) >= 2) & state & seated), told("confident", evidence))
        .when(some(gov), told("likely", evidence))
        .otherwise(told("likely", F.concat(F.lit(f"no government vocabulary on page {DASH} verify manually; "), evidence)))
    )


def gap_reason(notes: Column) -> Column:
    """What a gap's note says, up to its first colon or bracket, at most 52 characters."""
    return F.substring(F.trim(F.regexp_replace(F.replace(notes, F.lit("GAP: "), F.lit("")), "[:(](?s).*$", "")), 1, 52)


def externally_confirmed(notes: Column) -> Column:
    return F.lower(notes).rlike("externally verified|web-search verified|corrected:")


def candidate_rejection(ok: Column, status: Column, content_type: Column, generic: Column, is_elections_page: Column) -> Column:
    """Why a candidate page cannot be taken; null if it can."""
    return (
        F.when(~ok | (F.coalesce(status, F.lit(0)) >= 400), "candidate unreachable")
        .when(~is_html(content_type), "candidate is non-HTML")
        .when(generic, "candidate redirects to a statewide portal")
        .when(is_elections_page, "folded into elections page")
    )
