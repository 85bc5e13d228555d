"""The bounded crawl from a county's homepage to the draft of its pages, as joins of links with captures.

Nothing is fetched here: captures say what came back for a URL and links what a captured page links to. The crawl has a fixed
depth. An elections page is looked for among the homepage's links, then among those of the rendered homepage, then on
the two best department pages; each step takes only counties that the steps before have left open. An elections page may
hand off to a portal of its own; up to two hub pages on the county's or the portal's site are read as well. Polling, early
voting and results then come from all links seen, the deepest first. Every step is an equi-join on URLs and a ranking
in one county, so a link is shuffled as often as there are steps that look at it, and no step grows with the depth of a site.
What several later steps read is checkpointed, so that a plan has one step and a lost executor costs no more than that.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import candidate_rejection
from ..functions.scoring import weak_note
from ..functions.urls import is_external, is_generic_portal, plausible_target, stabilized
from ..functions.vocabulary import DISCOVERED_TYPES
from .discovery import department_pages, hub_pages, portals, ranked_links, trimmed, unreachable

C = ["county"]
CANDIDATES = 4  # of a ranking that are tried


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, as spark.checkpoint.dir names it; a session on one machine without one gets its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(f"/tmp/spark-{uuid.uuid4().hex[:12]}")
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df, checkpointed."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def page_name(url: Column) -> Column:
    """The last part of a URL's path, by which notes call a page."""
    return F.element_at(F.split(trimmed(url), "/"), -1)


def _captured(captures: DataFrame, path: str = "plain") -> DataFrame:
    """One capture for each URL, what it is taken for, and why it cannot be (null if it can)."""
    own = captures.filter(F.col("path") == path).groupBy("requested_url").agg(F.min(F.struct("ok", "http_status", "content_type", "final_url", "error")).alias("c"))
    reason = candidate_rejection(F.coalesce("c.ok", F.lit(False)), F.col("c.http_status"), F.col("c.content_type"), is_generic_portal(F.coalesce("c.final_url", F.lit(""))), F.lit(False))
    return own.select(F.col("requested_url").alias("url"), "c.*", reason.alias("reason"))


def _links_of(pages: DataFrame, links: DataFrame, path: str, source: int) -> DataFrame:
    """Links of pages (county, home, url): county, home, pos, text, url. pos keeps those of a smaller source in front."""
    own = links.filter(F.col("path") == path).select(F.col("page_url").alias("_page"), "pos", "text", "url")
    found = pages.select("county", "home", F.col("url").alias("_page")).join(own, "_page").drop("_page")
    return found.withColumn("pos", F.lit(source).cast("long") * 1_000_000_000 + F.col("pos"))


def _tried(links: DataFrame, seen: DataFrame, taken: DataFrame, why: str, order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(picks, failures) of the best elections candidates among links: county, url, text, score, why; county, step, rank, reason."""
    ranked = ranked_links(links, "elections", [*C, "home"], "home", taken).filter(F.col("rank") <= CANDIDATES)
    judged = ranked.join(seen.select("url", "final_url", "reason", F.lit(True).alias("_seen")), "url", "left").withColumn("reason", F.when(F.col("_seen").isNull(), "candidate unreachable").otherwise(F.col("reason")))
    judged = settled(judged)
    good = judged.filter("reason is null").groupBy(*C).agg(F.min_by(F.struct(F.col("final_url").alias("url"), "text", "score"), "rank").alias("p"))
    failed = judged.filter("reason is not null").select(*C, "rank", F.concat_ws(" -> ", page_name(F.col("url")), "reason").alias("reason"))
    return good.select(*C, "p.*", F.lit(why).alias("why")), failed


def crawl(homepages: DataFrame, captures: DataFrame, links: DataFrame) -> DataFrame:
    """county, batch, page_type, url, external, notes, why: four rows for each homepage, with the step that decided each.

    homepages (county, batch, homepage), one row for each county; captures (requested_url, path, ok, http_status, content_type, final_url, error);
    links (page_url, path, pos, text, url): page_url is the requested URL of a capture. path is `plain` or `headless`. A
    URL without a capture counts as unreachable. A county without a homepage has no rows.
    """
    seen, rendered = settled(_captured(captures)), _captured(captures, "headless")
    home = homepages.filter(F.trim("homepage") != "").select("county", "batch", F.col("homepage").alias("url")).join(seen, "url", "left")
    home = home.withColumns({"ok": F.coalesce("ok", F.lit(False)), "error": F.coalesce("error", F.lit(""))})
    down = unreachable(home).withColumn("why", F.lit("homepage"))
    live = settled(home.filter("ok and coalesce(http_status, 0) < 400").withColumn("home", F.col("url")))
    taken = live.select("county", "home", F.explode(F.array_distinct(F.array(trimmed(F.col("home")), trimmed(F.coalesce("final_url", "home"))))).alias("site"))

    # an elections page: from the homepage, from the rendered one, from department pages
    home_links = settled(_links_of(live, links, "plain", 5))
    picks, failed = _tried(home_links, seen, taken, "homepage link")
    failures = failed.withColumn("step", F.lit(1))
    open_ = settled(live.join(picks, C, "left_anti"))
    render_links = settled(_links_of(open_.join(rendered.filter("reason is null").select("url"), "url", "left_semi"), links, "headless", 4))
    more, failed = _tried(render_links, seen, taken, "rendered homepage")
    picks, failures = picks.unionByName(more), failures.unionByName(failed.withColumn("step", F.lit(2)))
    open_ = settled(open_.join(more, C, "left_anti"))
    nav = home_links.join(open_.select("county"), C, "left_semi").unionByName(render_links)
    offices = settled(department_pages(nav, [*C, "home"], "home", taken).join(seen.filter("reason is null").select("url"), "url", "left_semi"))
    office_links = []
    for rank in (1, 2):
        own = settled(_links_of(offices.filter(F.col("rank") == rank), links, "plain", 3).join(picks, C, "left_anti"))
        more, failed = _tried(own, seen, taken, "department page")
        picks, failures = picks.unionByName(more), failures.unionByName(failed.withColumn("step", F.lit(2 + rank)))
        office_links.append(own.join(more.select("county"), C, "left_semi"))

    # the elections page, or the portal that it hands off to
    page = settled(live.select("county", "home").join(picks, C).withColumnRenamed("url", "elections"))
    page_links = settled(_links_of(page.select("county", "home", F.col("elections").alias("url")), links, "plain", 2).join(page.select("county", "elections"), C))
    handed = portals(page_links, C, "elections").select(*C, F.col("portal").alias("url")).join(seen.filter("reason is null").select("url", F.col("final_url").alias("portal")), "url")
    page = settled(page.join(handed.select(*C, "portal"), C, "left").withColumn("stub", F.when(F.col("portal").isNotNull(), F.col("elections"))).withColumn("elections", F.coalesce("portal", "elections")))
    of_portal = _links_of(page.filter("portal is not null").select("county", "home", F.col("elections").alias("url")), links, "plain", 2)
    page_links = settled(page_links.drop("elections").join(page.filter("portal is null").select("county"), C, "left_semi").unionByName(of_portal).join(page.select("county", "elections"), C))
    taken = taken.unionByName(page.select("county", "home", F.explode(F.array_compact(F.array(trimmed(F.col("elections")), trimmed(F.col("stub"))))).alias("site"))).distinct()
    taken = settled(taken)

    # hub pages, and the links of all pages, the deepest first
    hubs = hub_pages(page_links, C, "home", "elections", taken.select("county", "site")).join(seen.filter("ok and coalesce(http_status, 0) < 400 and content_type like '%html%'").select("url", "final_url"), "url")
    hubs = settled(hubs)
    hub = hubs.groupBy(*C).agg(F.min_by("final_url", "rank").alias("hub"))
    own = hubs.join(live.select("county", "home"), C)
    deep = _links_of(own.filter("rank = 2"), links, "plain", 0).unionByName(_links_of(own.filter("rank = 1"), links, "plain", 1)).unionByName(page_links.drop("elections"))
    for part in (*office_links, render_links, home_links):
        deep = deep.unionByName(part)

    deep = settled(deep)
    base = live.select("county", "batch", "home").join(page.select("county", "elections", "stub", "text", "score", "why"), C, "left").join(hub, C, "left")
    base = settled(base)
    tried = failures.groupBy(*C).agg(F.array_sort(F.collect_list(F.struct("step", "rank", "reason"))).alias("t")).select(*C, F.concat(F.lit(" (tried: "), F.array_join(F.slice(F.col("t.reason"), 1, 3), "; "), F.lit(")")).alias("tried"))
    found = lambda kind: F.concat_ws(" ", F.concat(F.lit('found via "'), F.substring("text", 1, 40), F.lit('" score='), F.col("score")), F.nullif(weak_note(F.col("score"), kind), F.lit("")))
    note = F.when(F.col("stub").isNotNull(), F.concat(F.lit("dedicated elections portal, reached via "), page_name(F.col("stub")))).when(F.col("elections").isNotNull(), found(F.lit("elections")))
    first = base.join(tried, C, "left").select(
        "county", "batch", "home", F.lit("elections").alias("page_type"), F.coalesce("elections", F.lit("")).alias("url"),
        F.coalesce(note, F.concat(F.lit("GAP: no working elections page found"), F.coalesce("tried", F.lit("")))).alias("notes"),
        F.when(F.col("stub").isNotNull(), "portal").otherwise(F.coalesce("why", F.lit("none"))).alias("why"),
    )
    rows = first
    for kind in DISCOVERED_TYPES[1:]:
        best = ranked_links(deep, kind, [*C, "home"], "home", taken).filter("rank = 1").select(*C, F.col("url").alias("pick"), F.col("text").alias("t"), F.col("score").alias("s"))
        x = base.join(best, C, "left").join(seen.select(F.col("url").alias("pick"), "ok", "http_status", "content_type", "final_url", "reason"), "pick", "left")
        off = F.col("pick").isNotNull() & ~plausible_target(F.col("pick"), F.col("county"), F.col("home"), F.coalesce("elections", F.lit("")))
        bad = F.when(F.col("pick").isNotNull() & ~off, F.when(F.col("ok").isNull(), "candidate unreachable").otherwise(F.col("reason")))
        good = F.col("pick").isNotNull() & ~off & bad.isNull()
        to_hub = F.lit(kind in ("polling", "early_voting")) & ~good & F.coalesce(trimmed(F.col("hub")) != trimmed(F.col("elections")), F.lit(False))
        shown = found(F.lit(kind))
        x = x.withColumns({"text": F.col("t"), "score": F.col("s")})
        notes = (
            F.when(good, shown).when(to_hub, f"no standing {kind} page; using per-election hub page (shared with other types) — review")
            .when(off, "GAP: no county-specific page found").when(bad.isNotNull(), F.concat(F.lit("GAP: "), bad))
            .otherwise(F.concat(F.lit("GAP: no distinct page found"), F.when(F.col("elections").isNotNull(), " (likely folded into elections page)").otherwise("")))
        )
        url = F.when(good, stabilized(F.col("final_url"))).when(to_hub, F.col("hub")).otherwise("")
        why = F.when(good, "link").when(to_hub, "hub page").otherwise("none")
        rows = rows.unionByName(x.select("county", "batch", "home", F.lit(kind).alias("page_type"), url.alias("url"), notes.alias("notes"), why.alias("why")))
    external = F.when((F.col("url") != "") & is_external(F.col("url"), F.col("home")), "true").otherwise("false")
    out = rows.withColumn("external", external).drop("home")
    return out.unionByName(down.select(*out.columns)).select("county", "batch", "page_type", "url", "external", "notes", "why")
