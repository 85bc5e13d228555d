"""Rules that need planted cases: cleaning, scores with their own weights, crawls, identity. Every row of a table gets one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scoring as S
from ..functions import urls as U
from ..functions import values as X
from ..functions.vocabulary import COMMERCIAL, DEPARTMENT_WEIGHTS, DISCOVERED_TYPES, ELECTION_LABELS, ERROR_PAGE, FIRST_WEIGHTS, GOV, HUB_WEIGHTS, LINK_WEIGHTS, MINIMUM, NON_GOV, NON_GOV_TITLE, PARKED
from ..operators import captures as C
from ..operators import discovery as D
from ..operators import html as P
from ..operators import integrity as I
from ..operators import manifest as M
from .inputs import COUNTIES, HISTORY, TARGETS, counties, history, links_sql, spread, table, targets
from .pages import links, quoted
from .registry import query

# ---- cleaning: one page for each document, which meets every rule ----
#: {i}: the document's number, {m}: its hash.
PAGE = """<html class="js no-js own{i}"><head><title>T {i}</title><meta name="csrf-token" content="{m}"><meta itemprop="build-id" content="{m}"><meta name="kept" content="k{i}"><link rel="preload" href="/a{m}.js"><link rel="canonical" href="/c{i}"></head><body class="loaded"><!-- {m} --><script>var a="{m}";</script><style>p</style><noscript>n</noscript><div class="hero-slideshow"><i style="background: URL({m}.png)">x</i></div><div class="slideshow" style="background: url({m}.png)">text {i}</div><div id="audioeye-{m}">gone</div><p data-nocache="{m}">gone</p><a href="/weather-widget/{i}">{m} C</a><input type="hidden" name="__VIEWSTATE" value="{m}"><input type="hidden" name="h{i}" value="{m}"><b nonce="{m}" data-style-uid="{m}" data-n="{i}">w   {i}</b><a href="/cdn-cgi/l/email-protection#{m}">mail</a><i id="gt-wrapper-{m}"></i><u class="widget wide n{i} paused"></u><form action="/f?ts={m}&amp;page={i}"></form><img src="/i{i}.png?v={m}"><p>Tue Jan 05 08:49:00 CDT 2026 18.4f78ce17.1784308058.1113f7d6</p></body></html>"""
CLEAN = """<html class="own{i}">|<head>|<title>|T {i}|</title>|<meta name="kept" content="k{i}">|<link rel="canonical" href="/c{i}">|</head>|<body>|<div class="hero-slideshow">|[rotating image slideshow removed for determinism]|</div>|<div class="slideshow">|text {i}|</div>|<a href="/weather-widget/{i}">|[live weather removed for determinism]|</a>|<input type="hidden" name="h{i}" value="">|<b data-n="{i}">|w {i}|</b>|<a href="/cdn-cgi/l/email-protection#REDACTED">|mail|</a>|<i id="gt-wrapper-X">|</i>|<u class="widget n{i}">|</u>|<form action="/f?page={i}">|</form>|<img src="/i{i}.png">|<p>|January 5, 2026 EDGE_REF_REDACTED|</p>|</body>|</html>|"""
TEXT = "T {i}|[rotating image slideshow removed for determinism]|text {i}|[live weather removed for determinism]|w {i}|mail|January 5, 2026 EDGE_REF_REDACTED|"


def expected(page: str) -> str:
    return f"replace(replace('{page}', '|', chr(10)), '{{i}}', cast(doc_id as varchar))"


@query("cleaned_rules", f"select doc_id, {expected(CLEAN)} as page_html, {expected(TEXT)} as page_txt, 'T ' || doc_id as title from documents")
def cleaned_rules(spark, d):
    i = F.col("doc_id").cast("string")
    html = F.replace(F.replace(F.lit(PAGE), F.lit("{i}"), i), F.lit("{m}"), F.md5(i.cast("binary")))
    return P.clean_pages(spread(table(spark, d, "documents").select("doc_id")).select("doc_id", html.alias("html"))).select("doc_id", "page_html", "page_txt", "title")


# ---- scores with their own weights: links of the pages, each with a keyword put before its text ----
WORDS = sorted({w for ws in (*LINK_WEIGHTS.values(), *FIRST_WEIGHTS.values(), HUB_WEIGHTS, DEPARTMENT_WEIGHTS) for w, _ in ws} | set(ELECTION_LABELS))
SITE = "regexp_extract({}, '([^./]*\\.[^./]*)(/|$)', 1)"
PLANTED = f"""{links_sql()}, planted as (select page_id, pos, page, [{', '.join(map(quoted, WORDS))}][(page_id + pos) % {len(WORDS)} + 1] || case when pos % 2 = 0 then '' else ' ' || text end as text,
    case pos % 5 when 0 then 'https://www.vote' || (page_id % 7) || '.example.net/x' || pos when 1 then 'https://elections.example.org/' || pos else url end as url, href from links),
    sited as (select *, regexp_extract(url, '^https?://([^/?#]*)', 1) as h, {SITE.format('url')} <> {SITE.format('page')} as away from planted)"""


def planted(spark, d):
    x, pos = links(spark, d), F.col("pos")
    word = F.element_at(F.array(*[F.lit(w) for w in WORDS]), ((F.col("page_id") + pos) % len(WORDS) + 1).cast("int"))
    far = F.concat(F.lit("https://www.vote"), (F.col("page_id") % 7).cast("string"), F.lit(".example.net/x"), pos.cast("string"))
    url = F.when(pos % 5 == 0, far).when(pos % 5 == 1, F.concat(F.lit("https://elections.example.org/"), pos.cast("string"))).otherwise(F.col("url"))
    return x.select("page_id", pos, "page", F.when(pos % 2 == 0, word).otherwise(F.concat(word, F.lit(" "), "text")).alias("text"), url.alias("url"), "href")


def weighed(weights, text="text", url="url"):
    cases = (f"case when contains(lower({text}), {quoted(w)}) then {n} when contains(regexp_replace(lower({url}), '[-_/]', ' ', 'g'), {quoted(w)}) then {max(1, n // 2) if n > 0 else n} else 0 end" for w, n in weights)
    return "(" + " + ".join(cases) + ")"


LABEL = "string_split(regexp_replace(h, '^www\\.', ''), '.')[1]"
ELECTIONS = f"({weighed(LINK_WEIGHTS['elections'])} + case when lower(trim(text)) in ({', '.join(map(quoted, ELECTION_LABELS))}) then 8 else 0 end + case when contains({LABEL}, 'vote') or {LABEL} = 'elections' then 12 else 0 end)"


@query("scored_links", f"with {PLANTED} select page_id, pos, cast({ELECTIONS} as int) as elections, " + ", ".join(f"cast({weighed(LINK_WEIGHTS[k])} as int) as {k}" for k in DISCOVERED_TYPES[1:]) + " from sited")
def scored_links(spark, d):
    x = planted(spark, d)
    return x.select("page_id", F.col("pos").cast("long").alias("pos"), *[S.link_score(F.col("text"), F.col("url"), k).alias(k) for k in DISCOVERED_TYPES])


def ranked_sql(score: str, less: str, more: str = "true") -> str:
    """Ranked links whose score, and what is left of it off the county's site, are over 0."""
    return f"""w as (select *, {score} as s from sited), w2 as (select *, s - {less} as score from w where s > 0), o as (select *, rtrim(url, '/') as site from w2 where score > 0 and {more}),
        g as (select page_id, site, max(score) as score, min(pos) as first_pos, arg_max(url, (score, -pos)) as url from o group by all), k as (select page_id, row_number() over (partition by page_id order by score desc, length(url), first_pos) as rank, cast(score as int) as score, url from g)"""


@query("elections_candidates", f"with {PLANTED}, taken as (select page_id, rtrim(url, '/') as site from planted where pos = 2), {ranked_sql(ELECTIONS, 'case when away then 2 else 0 end', '(page_id, rtrim(url, chr(47))) not in (select (page_id, site) from taken)')} select page_id, rank, score, url from k where rank <= 4")
def elections_candidates(spark, d):
    """Links off the county's site count less; each page's third link is taken already."""
    x = planted(spark, d)
    taken = x.filter("pos = 2").select("page_id", D.trimmed(F.col("url")).alias("site"))
    return D.ranked_links(x, "elections", ["page_id"], home="page", exclude=taken).filter("rank <= 4").select("page_id", "rank", "score", "url")


@query("department_pages", f"with {PLANTED}, {ranked_sql(weighed(DEPARTMENT_WEIGHTS), 'case when away then 1 else 0 end')} select page_id, rank, score, url from k where rank <= 2")
def department_pages(spark, d):
    return D.department_pages(planted(spark, d), ["page_id"], "page").select("page_id", "rank", "score", "url")


@query("hub_pages", f"""with {PLANTED}, {ranked_sql(weighed(HUB_WEIGHTS), 'case when away then 1 else 0 end')},
    own as (select k.*, page from k join (select distinct page_id, page from planted) using (page_id) where rank <= 4 and ({SITE.format('k.url')} = {SITE.format('page')} or {SITE.format('k.url')} = 'example.org'))
    select page_id, row_number() over (partition by page_id order by rank) as rank, score, url from own qualify row_number() over (partition by page_id order by own.rank) <= 2""")
def hub_pages(spark, d):
    x = planted(spark, d).withColumn("elections", F.lit("https://elections.example.org/"))
    return D.hub_pages(x, ["page_id"], "page", "elections")


@query("portals", f"with {PLANTED} select page_id, arg_min(url, pos) as portal from sited where (contains({LABEL}, 'vote') or {LABEL} = 'elections') and away group by 1")
def portals(spark, d):
    return D.portals(planted(spark, d), ["page_id"], "page")


SUGGESTED = PLANTED + ", s as (select page_id, url, max(" + " + ".join(f"case when contains(lower(text || ' ' || url), {quoted(w)}) then {n} else 0 end" for w, n in FIRST_WEIGHTS["polling"]) + ") as score from sited group by all)"


@query("suggested_links", f"with {SUGGESTED} select page_id, row_number() over (partition by page_id order by score desc, url) as rank, cast(score as int) as score, url from s where score > 0 qualify row_number() over (partition by page_id order by score desc, url) <= 6")
def suggested_links(spark, d):
    return D.suggestions(planted(spark, d), "polling", ["page_id"])


@query("candidate_reports", f"""with {SUGGESTED}, n as (select page_id, least(6, count(*)) as n, max(score) as best from s where score > 0 group by 1)
    select page_id, url as homepage, case when page_id % 5 = 0 then 'timeout' end as error, case when page_id % 5 <> 0 then coalesce(n, 0) end as n_suggestions, case when page_id % 5 <> 0 then cast(best as int) end as best_score from pages left join n using (page_id)""")
def candidate_reports(spark, d):
    """Pages are homepages; every fifth was not to be had."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("county"), F.col("url").alias("homepage"), F.when(F.col("page_id") % 5 == 0, "timeout").alias("error"))
    s = D.suggestions(planted(spark, d), "polling", ["page_id"]).withColumnRenamed("page_id", "county").withColumn("page_type", F.lit("polling"))
    r = D.candidates_report(s, pages)
    n = F.when(F.col("suggestions").isNotNull(), F.size("suggestions")).cast("long")
    return r.select(F.col("county").alias("page_id"), "homepage", "error", n.alias("n_suggestions"), F.get("suggestions", F.lit(0))["score"].alias("best_score"))


LEAST = "case " + " ".join(f"when page_type = '{k}' then {v}" for k, v in MINIMUM.items()) + " end"


@query("weak_matches", f"with {TARGETS} select county, page_type, case when length(url) % 15 < {LEAST} then '(weak match — review)' else '' end as note from targets where page_type <> 'homepage'")
def weak_matches(spark, d):
    t = targets(spark, d).filter("page_type <> 'homepage'")
    return t.select("county", "page_type", S.weak_note(F.length("url") % 15, F.col("page_type")).alias("note"))


@query("link_hosts", f"with {PLANTED} select page_id, pos, h <> regexp_extract(page, '^https?://([^/?#]*)', 1) as host_differs, not away or contains(regexp_replace(lower(url), '[^a-z0-9]', '', 'g'), 'vote' || (page_id % 3)) as plausible from sited")
def link_hosts(spark, d):
    """Counties are called vote0 to vote2."""
    u, p = F.col("url"), F.col("page")
    x = planted(spark, d).withColumn("county", F.concat(F.lit("Vote "), (F.col("page_id") % 3).cast("string")))
    return x.select("page_id", F.col("pos").cast("long").alias("pos"), U.host_differs(u, p).alias("host_differs"), U.plausible_target(u, F.col("county"), p, F.lit("")).alias("plausible"))


@query("thin_pages", "select page_id, page_id % 6 = 0 or page_id % 11 = 0 or len(regexp_extract_all(lower(html), '<a\\s[^>]*href=')) < 5 as few from pages")
def thin_pages(spark, d):
    i = F.col("page_id")
    return table(spark, d, "pages").select("page_id", R.few_links(i % 6 != 0, F.when(i % 11 == 0, 404).otherwise(200), F.col("html")).alias("few"))


@query("capture_records", f"with {HISTORY} select capture_id, strftime(fetched_at, '%Y-%m-%dT%H:%M:%SZ') as fetched, case when capture_id % 3 = 0 then 1 else 2 end as n_chain, final_url as last_url from history")
def capture_records(spark, d):
    h = history(spark, d)
    chain = U.redirect_chain(F.when(F.col("capture_id") % 3 == 0, F.col("final_url")).otherwise("http://a.example.org/"), F.col("final_url"))
    return h.select("capture_id", X.iso_utc(F.col("fetched_at")).alias("fetched"), F.size(chain).cast("long").alias("n_chain"), F.element_at(chain, -1).alias("last_url"))


@query("unreachable_homepages", f"""with {COUNTIES}, c as (select *, cast(right(county, 9) as bigint) as k from counties)
    select county, batch, page_type, '' as url, 'false' as external, 'GAP: could not crawl — homepage blocked/unreachable (' || case when k % 4 = 0 then 'timeout' else 'HTTP 403' end || '); needs manual URL discovery' as notes
    from c, (values ('elections'), ('polling'), ('early_voting'), ('results')) t(page_type) where k % 4 = 0 or k % 6 = 1""")
def unreachable_homepages(spark, d):
    k = F.substring("county", -9, 9).cast("long")
    h = counties(spark, d).withColumns({"ok": k % 4 != 0, "http_status": F.when(k % 4 == 0, F.lit(None)).when(k % 6 == 1, 403).otherwise(200).cast("int"), "error": F.when(k % 4 == 0, "timeout")})
    return D.unreachable(h)


@query("seed_of_batches", "select c_name as county, case when c_custkey % 2 = 0 then 'a' else 'b' end as seat, case when c_custkey % 2 = 0 then '1' when c_custkey % 3 = 0 then '2' else '3' end as batch, case when c_custkey % 2 = 0 then 'http://h' else '' end as homepage from customer")
def seed_of_batches(spark, d):
    """A county that several batches name belongs to the first."""
    c = table(spark, d, "customer").select(F.col("c_name").alias("county"), "c_custkey")
    one = c.filter("c_custkey % 2 = 0").select("county", F.lit("a").alias("seat"), F.lit("http://h").alias("homepage"))
    more = lambda cond: c.filter(cond).select("county", F.lit("b").alias("seat"), F.lit("").alias("homepage"))
    return M.seed_union(("1", one), ("2", more("c_custkey % 3 = 0")), ("3", more("true")))


@query("integrity_homepages", f"with {COUNTIES} select county, batch from counties where batch = '1' and cast(right(county, 9) as bigint) % 7 = 0")
def integrity_homepages(spark, d):
    k = F.substring("county", -9, 9).cast("long")
    return I.bad_homepages(counties(spark, d).withColumn("homepage", F.when(k % 7 == 0, "ftp://x").otherwise("https://x"))).select("county", "batch")


@query("integrity_batch_overlap", "select c_name as county, 2 as batches from customer where c_custkey % 9 = 0")
def integrity_batch_overlap(spark, d):
    c = counties(spark, d)
    k = F.substring("county", -9, 9).cast("long")
    return I.batch_overlap(c.unionByName(c.filter(k % 9 == 0).withColumn("batch", F.lit("9")))).select("county", "batches")


@query("integrity_metadata", f"with {TARGETS} select county, page_type from targets where url <> '' and (length(url) % 5 = 1 or length(url) % 7 = 2 or length(url) % 9 = 4)")
def integrity_metadata(spark, d):
    """Records without a hash, of an unknown mode, of another URL."""
    t, n = targets(spark, d).filter("url <> ''"), F.length("url")
    s = t.select(
        "county", "page_type", F.when(n % 9 == 4, "http://other").otherwise(F.col("url")).alias("requested_url"), F.lit(200).alias("http_status"), F.lit(False).alias("external"), F.lit("t").alias("fetched_at"),
        F.when(n % 5 != 1, "h").alias("html_sha256"), F.lit("t").alias("text_sha256"), F.lit(1).alias("byte_size"), F.when(n % 7 == 2, "other").otherwise("plain").alias("render_mode"),
    )
    return I.bad_metadata(s, t).select("county", "page_type")


@query("integrity_stamped_bodies", "select doc_id from documents where doc_id % 13 = 0 and text is not null")
def integrity_stamped_bodies(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    at = F.concat(F.lit("2026-07-28T12:31:37Z#"), F.col("doc_id").cast("string"))
    return I.stamped_bodies(docs.select("doc_id", F.when(F.col("doc_id") % 13 == 0, F.concat("text", at)).otherwise(F.col("text")).alias("body"), at.alias("fetched_at"))).select("doc_id")


@query("targets_with_captures", f"with {TARGETS}, c as (select c_custkey, 'https://' || lower(c_mktsegment) || c_custkey || '.example.org/results' as u from customer where c_custkey % 3 = 0) select county, page_type, c.c_custkey as capture from targets left join c on url = u where url <> ''")
def targets_with_captures(spark, d):
    address = F.concat(F.lit("https://"), F.lower("c_mktsegment"), F.col("c_custkey").cast("string"), F.lit(".example.org/results"))
    caps = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(address.alias("requested_url"), F.col("c_custkey").alias("capture"))
    return C.for_targets(targets(spark, d).filter("url <> ''"), caps).select("county", "page_type", "capture")


# ---- errors and identity of documents, with marks put before their texts ----
@query("error_labels", """select doc_id, case when doc_id % 7 = 0 and doc_id % 5 <> 0 then 'bot_challenge_not_cleared: page shows a bot check' || case when doc_id % 3 = 0 then '; timeout' when doc_id % 4 = 0 then '; non_html_content: application/pdf' else '' end
    when doc_id % 3 = 0 then 'timeout' when doc_id % 4 = 0 then 'non_html_content: application/pdf' end as error from documents""")
def error_labels(spark, d):
    k = F.col("doc_id")
    html = F.when(k % 7 == 0, "<p>Just a Moment").otherwise("<p>page")
    label = R.error_label(F.when(k % 3 == 0, "timeout"), html, F.when(k % 4 == 0, "application/pdf").otherwise("text/html"), F.lit(None).cast("string"), F.when(k % 5 == 0, "").otherwise("text"), html)
    return table(spark, d, "documents").select("doc_id", label.alias("error"))


MARKS = ["", "the county of this state of texas, the county commissioners and the sheriff. ", "county of the, tx: elections. ", "the county texas of records sheriff tax commissioners court ", f"{GOV[0]} the county of ", f"{COMMERCIAL[0]} the county texas of ", f"{PARKED[0]} ", f"{ERROR_PAGE[0]} ", " ".join(NON_GOV[:3]) + " the county texas ", "the county of elsewhere "]


def held(words, text):
    return f"list_filter([{', '.join(map(quoted, words))}], lambda w: contains({text}, w))"


def first(c, n):
    return f"array_to_string({c}[1:{n}], ', ')"


LADDER = f"""d as (select doc_id, [{', '.join(map(quoted, MARKS))}][doc_id % {len(MARKS)} + 1] || text as text, source from documents),
    h as (select doc_id, text, source, lower(coalesce(source, '') || ' ' || text) as hay, lower(coalesce(source, '')) as t from d),
    s as (select *, {held(GOV, 'hay')} as gov, {held(COMMERCIAL, 'hay')} as com, {held(NON_GOV, 'hay')} as org, {held(NON_GOV_TITLE, 't')} as torg, {held(PARKED, 'left(hay, 4000)')} as parked, {held(PARKED, 't')} as tparked, {held(ERROR_PAGE, 'left(hay, 2000)')} as err,
        length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as n, regexp_matches(hay, '\\bthe\\b\\s*''?s?\\s+county\\b') or regexp_matches(hay, '\\bcounty\\s+of\\s+the\\b') as named,
        contains(hay, 'texas') or regexp_matches(hay, '\\btx\\b') as state, regexp_matches(hay, '\\bof\\b') as seated, doc_id % 2 = 0 as official from h),
    e as (select *, coalesce(nullif(concat_ws('; ', case when named then '''The'' in page' end, case when seated then 'seat ''Of'' in page' end, case when state then 'Texas/TX present' end,
        case when official then 'official TLD (' || array_to_string(string_split(lower(source) || '.gov', '.')[-2:], '.') || ')' end, case when len(gov) > 0 then 'gov signals: ' || {first('gov', 3)} end), ''), 'no signals') as ev from s),
    v as (select doc_id, case when len(parked) > 0 and (len(tparked) > 0 or (n < 800 and len(gov) = 0)) then ['reject', 'parked/placeholder domain (' || parked[1] || ')'] when len(err) > 0 then ['reject', 'error page'] when n < 120 then ['reject', 'near-empty page (' || n || ' chars)']
        when len(com) > 0 and len(gov) < 2 then ['reject', 'commercial site (' || com[1] || ') {R.DASH} ' || ev]
        when len(torg) > 0 or (len(org) >= 3 and len(org) > len(gov)) then ['reject', 'not the county government {R.DASH} looks like a tourism/EDC/chamber site (' || case when len(torg) > 0 then {first('torg', 2)} else {first('org', 2)} end || ') {R.DASH} ' || ev]
        when not named then ['reject', 'page does not identify as ''The County'' {R.DASH} ' || ev] when not (state or seated) then ['reject', 'no Texas/seat signal (possible wrong-state county) {R.DASH} ' || ev]
        when official or (len(gov) >= 2 and state and seated) then ['confident', ev] when len(gov) > 0 then ['likely', ev] else ['likely', 'no government vocabulary on page {R.DASH} verify manually; ' || ev] end as v from e)"""


def marked(spark, d):
    k = F.col("doc_id")
    mark = F.element_at(F.array(*[F.lit(m) for m in MARKS]), (k % len(MARKS) + 1).cast("int"))
    x = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    return x.select("doc_id", "source", F.concat(mark, "text").alias("text"), F.concat(F.lit("https://"), "source", F.when(k % 2 == 0, ".gov/").otherwise(".org/")).alias("url"))


@query("verified_documents", f"with {LADDER} select doc_id, v[1] as confidence, v[2] as evidence from v")
def verified_documents(spark, d):
    """Documents as pages of the county "The", whose seat is "Of"."""
    v = R.verify(F.lit("The"), F.lit("Of"), F.col("url"), F.col("text"), F.col("source"), F.array().cast("array<string>"))
    return marked(spark, d).select("doc_id", v.alias("v")).select("doc_id", "v.confidence", "v.evidence")


@query("unverified_homepages", f"with {LADDER} select doc_id as county, v[2] as evidence from v where v[1] = 'reject'")
def unverified_homepages(spark, d):
    x = marked(spark, d).select(F.lit("The").alias("county"), F.lit("Of").alias("seat"), F.concat_ws("#", "url", F.col("doc_id").cast("string")).alias("url"), "text", F.col("source").alias("title"), F.array().cast("array<string>").alias("others"))
    return I.unverified_homepages(x).select(F.regexp_extract("url", "#([0-9]+)$", 1).cast("long").alias("county"), "evidence")


#: Counties with names of two to six words; a third of them ends in the name of another.
NAMED = """n as (select c_custkey as k, case c_custkey % 3 when 0 then 'New ' || c_mktsegment || ' Of The North ' || (c_custkey + 1) when 1 then 'North ' || c_custkey else c_mktsegment || ' ' || c_custkey end as name from customer),
    p as (select a.k, a.name, case a.k % 6 when 0 then a.name || ' County, Texas' when 1 then coalesce(b.name, '') || ' County Clerk' when 2 then a.name || ' County | ' || coalesce(b.name, '') || '	County' when 3 then coalesce(b.name, '') || chr(10) || 'County'
    when 4 then 'About ' || coalesce(c.name, '') || ' County and ' || coalesce(b.name, '') || ' County' else 'County of ' || a.name end as title from n a left join n b on b.k = a.k + 1 left join n c on c.k = a.k - 1),
    m as (select p.k, lower(p.name) as own, lower(n.name) as other from p join n on n.k <> p.k and contains(' ' || replace(lower(p.title), chr(9), ' '), ' ' || lower(n.name) || ' county')),
    g as (select k, list_sort(list(distinct other) filter (contains(other, own))) as longer, list_sort(list(distinct other)) as others from m where not contains(own, other) group by k)"""


@query("titles_of_others", f"with {NAMED} select p.k, case when len(longer) > 0 then array_to_string(longer, ', ') else array_to_string(others, ', ') end as others, case when others is null then 'likely' else 'reject' end as confidence, case when others is not null then 'title identifies another county (' || array_to_string((case when len(longer) > 0 then longer else others end)[1:2], ', ') || ')' else '' end as told from p left join g using (k)")
def titles_of_others(spark, d):
    """Titles that name the own county, the one before or after, both, or none on one line; each page says what it is."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("New "), "c_mktsegment", F.lit(" Of The North "), (k + 1).cast("string"))).when(k % 3 == 1, F.concat(F.lit("North "), k.cast("string"))).otherwise(F.concat("c_mktsegment", F.lit(" "), k.cast("string")))
    n = c.select(k.alias("k"), name.alias("county"))
    near = lambda by, to: n.select((F.col("k") + by).alias("k"), F.col("county").alias(to))
    x = n.join(near(-1, "b"), "k", "left").join(near(1, "c"), "k", "left").withColumns({"b": F.coalesce("b", F.lit("")), "c": F.coalesce("c", F.lit(""))})
    own, b, s = F.col("county"), F.col("b"), F.col("k") % 6
    title = (
        F.when(s == 0, F.concat(own, F.lit(" County, Texas"))).when(s == 1, F.concat(b, F.lit(" County Clerk"))).when(s == 2, F.concat(own, F.lit(" County | "), b, F.lit("\tCounty")))
        .when(s == 3, F.concat(b, F.lit("\nCounty"))).when(s == 4, F.concat(F.lit("About "), "c", F.lit(" County and "), b, F.lit(" County"))).otherwise(F.concat(F.lit("County of "), own))
    )
    pages = x.select("k", "county", title.alias("title"), F.concat(own, F.lit(" County, Texas. "), F.repeat(F.lit("Plain words. "), 12)).alias("text"))
    found = pages.join(D.other_counties(pages, n, "k"), "k", "left").withColumn("o", F.coalesce("others", F.array().cast("array<string>")))
    v = R.verify(F.col("county"), F.lit("Nowhere"), F.lit("https://x.org/"), F.col("text"), F.col("title"), F.col("o"))
    told = F.regexp_extract("v.evidence", r"^(title identifies another county \([^)]*\))", 1)
    return found.withColumn("v", v).select("k", F.when(F.size("o") > 0, F.array_join(F.array_sort("o"), ", ")).alias("others"), "v.confidence", told.alias("told"))


def _words(which):
    """SQL: the words of a document's page type that it holds."""
    held = lambda words: f"list_filter([{', '.join(map(quoted, words))}]::varchar[], lambda w: contains(hay, w))"
    return f"case when kind = 'homepage' then {held(which.get('homepage', []))} else {held(which.get('results', []))} end"


#: A strong and a weak word of a homepage and of a page of results, which every fifth document holds.
HELD = [(words.get(kind) or [""])[0] for words in (R.STRONG, R.WEAK) for kind in ("homepage", "results")]
AUDIT = f"""k as (select doc_id, coalesce(source, '') as t, coalesce(text, '') || ' ' || case when doc_id % 5 > 1 then '' else [{", ".join(map(quoted, HELD))}][doc_id % 5 * 2 + doc_id % 2 + 1] end as text, case when doc_id % 2 = 0 then 'homepage' else 'results' end as kind, doc_id % 3 = 0 as root from documents),
    h as (select *, lower(t || chr(10) || text) as hay, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) as n from k),
    f as (select *, contains(hay, 'the') as named, contains(hay, 'of') as seated, {_words(R.STRONG)} as strong, {_words(R.WEAK)} as weak, list_filter([{", ".join(map(quoted, R.BAD_PAGE))}], lambda w: contains(hay, w)) as bad from h),
    p as (select *, named or (seated and kind <> 'homepage') as identity, concat_ws(' | ', nullif(concat_ws('; ', case when named then 'county name ''The'' in page' end, case when seated then 'seat ''Of'' in page' end), ''),
    case when len(strong) > 0 then kind || ' keywords: ' || array_to_string(strong[1:4], ', ') when len(weak) > 0 then 'weak ' || kind || ' keywords: ' || array_to_string(weak[1:3], ', ') end, case when t <> '' then 'title="' || t[1:70] || '"' end) as parts from f),
    c as (select *, case when parts = '' then 'no identity or topic keywords found' else parts end as reason, case when len(bad) > 0 or root then 'uncertain' when identity and len(strong) > 0 then 'confident' when identity and (len(weak) > 0 or kind = 'homepage') then 'likely' else 'uncertain' end as sure from p),
    s as (select *, n < 200 and len(bad) = 0 as thin, case when len(bad) > 0 then 'POSSIBLE ERROR PAGE (' || array_to_string(bad[1:2], ', ') || '); ' || reason when root then 'requested deep path redirected to site root (https://x.gov/); ' || reason
    when sure = 'uncertain' and (identity or len(strong) > 0) then 'only partial match {R.DASH} ' || reason else reason end as said from c)"""


@query("audited_redirects", f"with {AUDIT} select doc_id, case when thin and sure = 'confident' then 'likely' else sure end as confidence, case when thin then 'thin content (' || n || ' chars); ' || said else said end as reason, sure = 'uncertain' or (thin and sure <> 'confident') as flag from s")
def audited_redirects(spark, d):
    """Documents as homepages and pages of results of the county "The", whose seat is "Of"; every third deep page leads to the
    site's first page, and every fifth holds a word of its kind."""
    k = F.col("doc_id")
    more = F.when(k % 5 == 0, F.when(k % 2 == 0, HELD[0]).otherwise(HELD[1])).when(k % 5 == 1, F.when(k % 2 == 0, HELD[2]).otherwise(HELD[3])).otherwise("")
    x = spread(table(spark, d, "documents").select("doc_id", "source", "text")).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), more))
    kind, final = F.when(k % 2 == 0, "homepage").otherwise("results"), F.when(k % 3 == 0, "https://x.gov/").otherwise("https://x.gov/a/b/")
    a = R.audit_content(F.lit("The"), F.lit("Of"), kind, F.col("text"), F.col("source"), final, F.lit("https://x.gov/a/b"))
    return x.select("doc_id", a.alias("a")).select("doc_id", "a.confidence", "a.reason", "a.flag")
