"""Candidates for homepages and pages: links, their ranking, and the choice among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import candidate_rejection
from ..functions.scoring import first_score, internal_first, keyword_score, link_score
from ..functions.urls import host, is_external, is_generic_portal
from ..functions.vocabulary import DEPARTMENT_WEIGHTS, DISCOVERED_TYPES, EXTERNAL_PENALTY, HUB_WEIGHTS


def trimmed(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def ranked_links(links: DataFrame, page_type: str, keys: list[str], home: str | None = None, exclude: DataFrame | None = None, weights: list[tuple[str, int]] | None = None) -> DataFrame:
    """links (keys, pos, text, url) of a page type, the best first: best score of a URL (the first on ties), then the
    shorter URL, then the one seen first. Scores of 0 or less go before anything is shuffled. weights: keywords in place
    of the page type's own. exclude: (keys, site) of pages that are taken already, without their last slash."""
    score = keyword_score(F.col("text"), F.col("url"), weights) if weights else link_score(F.col("text"), F.col("url"), page_type)
    if home and page_type in EXTERNAL_PENALTY:
        score = internal_first(score, F.col("url"), F.col(home), page_type)
    return best_urls(links.withColumn("score", score).filter("score > 0"), keys, exclude)


def best_urls(scored: DataFrame, keys: list[str], exclude: DataFrame | None = None) -> DataFrame:
    """Links with scores, one for each URL, ranked."""
    scored = scored.withColumn("site", trimmed(F.col("url")))
    if exclude is not None:
        scored = scored.join(exclude, [*keys, "site"], "left_anti")
    best = F.max_by(F.struct("url", "text", "score"), F.struct("score", -F.col("pos"))).alias("b")
    each = scored.groupBy(*keys, "site").agg(best, F.min("pos").alias("first_pos")).select(*keys, "b.*", "first_pos")
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.length("url"), "first_pos")
    return each.withColumn("rank", F.row_number().over(w)).select(*keys, "rank", "score", "text", "url")


def suggestions(links: DataFrame, page_type: str, keys: list[str], k: int = 6) -> DataFrame:
    """The first batch's report: of each exact URL its best score, then the k best by score and URL."""
    s = first_score(F.col("text"), F.col("url"), page_type)
    scored = links.withColumn("score", s).filter("score > 0").groupBy(*keys, "url").agg(F.max("score").alias("score"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "url")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*keys, "rank", "score", "url")


def first_confident(tried: DataFrame, key: str = "county") -> DataFrame:
    """tried (key, priority, confidence, ...): the first confident candidate, else the first likely one."""
    order = F.when(F.col("confidence") == "confident", 0).when(F.col("confidence") == "likely", 1)
    w = Window.partitionBy(key).orderBy(order, "priority")
    return tried.withColumn("_o", order).filter("_o is not null").withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_o")


#: Fixed value: the evidence of a county that no candidate was found for.
NO_CANDIDATE = "no candidate pattern verified — needs web search"


def attempt_results(tried: DataFrame) -> DataFrame:
    """tried (county, priority, url, resolves, ok, error, http_status, confidence, evidence, final_url, title): what came of each attempt,
    as county, priority, url, result, status, final_url, title, evidence; the last four only of pages that were verified."""
    failed = F.when(~F.coalesce("resolves", F.lit(False)), "dns_fail").when(~F.coalesce("ok", F.lit(False)), F.concat(F.lit("fetch_fail:"), F.coalesce("error", F.lit(""))))
    failed = failed.when(F.col("http_status") >= 400, F.concat(F.lit("http_"), F.col("http_status").cast("string")))
    seen = failed.isNull()
    facts = [F.when(seen, F.col(c)).alias(n) for c, n in (("http_status", "status"), ("final_url", "final_url"), ("title", "title"), ("evidence", "evidence"))]
    return tried.select("county", "priority", "url", F.coalesce(failed, "confidence").alias("result"), *facts)


def resolved(counties: DataFrame, attempts: DataFrame) -> DataFrame:
    """counties (county, ...) with homepage, confidence, evidence, title and attempts: the first confident attempt, else the first likely
    one, else `unresolved`. Attempts after the first confident one were not made. A county has at most sixteen candidates; a county
    without any has an empty list. One shuffle of the attempts."""
    fields = ["priority", "url", "result", "status", "final_url", "title", "evidence"]
    logs = attempts.groupBy("county").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("a"))
    made = F.coalesce("a", F.array().cast(logs.schema["a"].dataType))
    first = lambda result: F.get(F.filter("attempts", lambda x: x["result"] == result), 0)
    end = F.array_position(F.transform("attempts", lambda x: x["result"]), "confident").cast("int")
    out = counties.join(logs, "county", "left").withColumn("attempts", made).drop("a")
    out = out.withColumn("attempts", F.when(end > 0, F.slice("attempts", 1, end)).otherwise(F.col("attempts"))).withColumn("_best", F.coalesce(first("confident"), first("likely")))
    none = F.col("_best").isNull()
    best = [F.when(none, "").otherwise(F.col("_best.final_url")).alias("homepage"), F.when(none, "unresolved").otherwise(F.col("_best.result")).alias("confidence")]
    best += [F.when(none, NO_CANDIDATE).otherwise(F.col("_best.evidence")).alias("evidence"), F.col("_best.title").alias("title")]
    return out.select(*counties.columns, *best, "attempts")


def until_confident(tried: DataFrame, key: str = "county") -> DataFrame:
    """The log of attempts: those up to the first confident one."""
    w = Window.partitionBy(key).orderBy("priority").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max((F.col("confidence") == "confident").cast("int")).over(w), F.lit(0))
    return tried.withColumn("_b", before).filter("_b = 0").drop("_b")


def first_valid(ranked: DataFrame, captures: DataFrame, keys: list[str], k: int = 4, elections: str | None = None) -> DataFrame:
    """Of the k best candidates the first whose capture can be taken; the others' reasons as `tried`, at most three."""
    page = captures.select(F.col("requested_url").alias("url"), "ok", "http_status", "content_type", "final_url")
    same = F.coalesce(F.col("final_url") == F.col(elections), F.lit(False)) if elections else F.lit(False)
    joined = ranked.filter(F.col("rank") <= k).join(page, "url", "left")
    reason = candidate_rejection(F.coalesce("ok", F.lit(False)), F.col("http_status"), F.col("content_type"), is_generic_portal(F.coalesce("final_url", F.lit(""))), same)
    judged = joined.withColumn("reason", reason)
    good = F.col("reason").isNull()
    return judged.groupBy(*keys).agg(
        F.min_by(F.when(good, F.struct("url", "score", "rank")), F.when(good, F.col("rank"))).alias("pick"),
        F.slice(F.array_sort(F.collect_list(F.when(~good, F.struct("rank", "reason")))), 1, 3).alias("tried"),
    )


def other_counties(pages: DataFrame, names: DataFrame, page_key: str) -> DataFrame:
    """(page_key, others): counties that a page's title names on one line, other than its own.

    Names inside the own name do not count; longer names that hold the own one go before all others. What stands before
    "county" in a title is cut at the names' lengths, wherever a word begins there, so that names of any number of words meet
    by equality in one pass over a title. The distinct lengths, a few numbers, come to the driver.
    """
    known = names.select(F.lower(F.trim("county")).alias("name")).filter("name <> ''").distinct()
    lengths = sorted(r[0] for r in known.select(F.length("name")).distinct().collect())
    title = F.lower(F.coalesce("title", F.lit("")))
    tails = [F.regexp_extract_all(title, F.lit(rf"(?U)\b(?=(.{{{n}}})\b[ \t]+county\b)"), 1) for n in lengths]
    cut = F.array_distinct(F.flatten(F.array(*tails))) if tails else F.array().cast("array<string>")
    named = pages.select(page_key, F.lower(F.trim("county")).alias("own"), F.explode(cut).alias("name"))
    found = named.join(known, "name").filter("name <> own")
    longer = F.contains(F.col("name"), F.col("own"))
    per = found.filter(~F.contains(F.col("own"), F.col("name"))).groupBy(page_key).agg(F.collect_set(F.when(longer, F.col("name"))).alias("l"), F.collect_set("name").alias("a"))
    return per.select(page_key, F.when(F.size("l") > 0, F.col("l")).otherwise(F.col("a")).alias("others"))


def with_fallbacks(picks: DataFrame) -> DataFrame:
    """url and notes of picks (page_type, pick_url, plausible, hub_url, elections_url): the pick if it is plausible;
    for polling and early voting else the first hub page that is not the elections page; else a gap that says why."""
    hub = F.when(F.col("page_type").isin("polling", "early_voting") & (F.col("hub_url") != F.col("elections_url")), F.col("hub_url"))
    off = F.col("pick_url").isNotNull() & ~F.col("plausible")
    url = F.when(off, F.lit("")).otherwise(F.coalesce("pick_url", hub, F.lit("")))
    folded = F.when(F.col("elections_url") != "", F.lit(" (likely folded into elections page)")).otherwise(F.lit(""))
    notes = F.when(off, F.lit("GAP: no county-specific page found")).when(url == "", F.concat(F.lit("GAP: no distinct page found"), folded)).otherwise(F.lit(""))
    return picks.withColumn("url", url).withColumn("notes", notes)


def department_pages(links: DataFrame, keys: list[str], home: str, exclude: DataFrame | None = None) -> DataFrame:
    """The two homepage links that look most like a list of departments: where an elections page is looked for next."""
    return _own_first(links, DEPARTMENT_WEIGHTS, keys, home, exclude).filter("rank <= 2")


def hub_pages(links: DataFrame, keys: list[str], home: str, elections: str, exclude: DataFrame | None = None) -> DataFrame:
    """Pages of single elections among an elections page's links: of the four best, the first two on the county's site
    or on its elections page's."""
    best = _own_first(links, HUB_WEIGHTS, keys, home, exclude).filter("rank <= 4")
    sites = links.select(*keys, home, elections).distinct()
    own = best.join(sites, keys).filter(~is_external(F.col("url"), F.col(home)) | ~is_external(F.col("url"), F.col(elections)))
    w = Window.partitionBy(*keys).orderBy("rank")
    return own.withColumn("rank", F.row_number().over(w)).filter("rank <= 2").select(*keys, "rank", "score", "url")


def _own_first(links: DataFrame, weights: list[tuple[str, int]], keys: list[str], home: str, exclude: DataFrame | None) -> DataFrame:
    score = keyword_score(F.col("text"), F.col("url"), weights)
    # what leaves the county's site is worth a point less
    less = score - F.when(is_external(F.col("url"), F.col(home)), 1).otherwise(0)
    return best_urls(links.withColumn("score", F.when(score > 0, less)).filter("score > 0"), keys, exclude)


def portals(links: DataFrame, keys: list[str], elections: str) -> DataFrame:
    """An elections page that only hands off to a portal of its own: its first link to another site whose host is named for
    voting and is no statewide one."""
    label = F.split(F.regexp_replace(host(F.col("url")), r"^www\.", ""), r"\.")[0]
    named = (label.contains("vote") | (label == "elections")) & ~is_generic_portal(F.col("url")) & is_external(F.col("url"), F.col(elections))
    return links.filter(named).groupBy(*keys).agg(F.min_by("url", "pos").alias("portal"))


def unreachable(homepages: DataFrame) -> DataFrame:
    """Four gaps for each county whose homepage fails (county, batch, ok, http_status, error): what could not be crawled."""
    failed = ~F.col("ok") | (F.coalesce("http_status", F.lit(0)) >= 400)
    why = F.coalesce(F.when(F.col("error") != "", F.col("error")), F.concat(F.lit("HTTP "), F.coalesce(F.col("http_status").cast("string"), F.lit("None"))))
    notes = F.concat(F.lit("GAP: could not crawl — homepage blocked/unreachable ("), why, F.lit("); needs manual URL discovery"))
    rows = homepages.filter(failed).withColumn("page_type", F.explode(F.array(*[F.lit(p) for p in DISCOVERED_TYPES])))
    return rows.select("county", "batch", "page_type", F.lit("").alias("url"), F.lit("false").alias("external"), notes.alias("notes"))


def candidates_report(suggested: DataFrame, homepages: DataFrame) -> DataFrame:
    """county, homepage, error, suggestions: for each homepage the ranked links of each page type, or what went wrong.

    suggested: county, page_type, rank, score, url (suggestions()); homepages: county, homepage, error."""
    each = F.sort_array(F.collect_list(F.struct("page_type", "rank", "score", "url")))
    found = suggested.groupBy("county").agg(each.alias("suggestions"))
    out = homepages.join(found, "county", "left")
    return out.select("county", "homepage", "error", F.when(F.col("error").isNull(), F.coalesce("suggestions", F.array())).alias("suggestions"))
