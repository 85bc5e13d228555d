"""Links, cleaning and rules over pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scoring as S
from ..functions import urls as U
from ..functions import values as X
from ..functions.vocabulary import BAD_PAGE, FIRST_WEIGHTS, GOV, INTERSTITIAL, JS_SHELL, MONTHS
from ..operators import discovery as D
from ..operators import history as H
from ..operators import html as P
from .inputs import decoded, links_sql, spread, table
from .registry import query


def links(spark, d):
    return P.extract_links(spread(table(spark, d, "pages").select("page_id", F.col("url").alias("page"), "html")), ["page_id", "page"], url="page")


@query("page_links", f"with {links_sql()} select page_id, pos, href, text, url from links")
def page_links(spark, d):
    return links(spark, d).select("page_id", F.col("pos").cast("long").alias("pos"), "href", "text", "url")


TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query("page_titles", f"select page_id, trim(regexp_replace({decoded(TITLE)}, '\\s+', ' ', 'g')) as title from pages")
def page_titles(spark, d):
    return spread(table(spark, d, "pages").select("page_id", "html")).select("page_id", P.titles(F.col("html")).alias("title"))


@query("cleaned_pages")
def cleaned_pages(spark, d):
    """Hashes and sizes of cleaned pages; held against idempotence and volatile tokens in the tests."""
    p = P.clean_pages(spread(table(spark, d, "pages").select("page_id", "url", "html")).withColumn("content_type", F.lit("text/html")).withColumn("error", F.lit(None).cast("string")))
    from ..operators.captures import snapshot_fields

    return snapshot_fields(p).select("page_id", "url", "html_sha256", "text_sha256", "byte_size", "title", "error")


@query("visible_texts", f"""with s as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gs'), '<style[^>]*>.*?</style>', ' ', 'gs'), '<!--.*?-->|<[^>]*>', ' ', 'gs') as t from pages)
    select page_id, sha256(trim(regexp_replace({decoded("t")}, '\\s+', ' ', 'g'))) as text_sha256 from s""")
def visible_texts(spark, d):
    return spread(table(spark, d, "pages").select("page_id", "html")).select("page_id", X.sha256(P.visible_text(F.col("html"))).alias("text_sha256"))


FIRST = " + ".join(f"case when contains(lower(text || ' ' || url), '{w}') then {n} else 0 end" for w, n in FIRST_WEIGHTS["results"])
#: The test tables' links are made of syllables: their own frequent ones stand for keywords.
SYLLABLES = [("the", 5), ("tion", 3), ("er", 4), ("de", 2), ("on", -2), ("ing", 7)]


def _weighed(t, u):
    return " + ".join(f"case when contains(lower({t}), '{w}') then {n} when contains(regexp_replace(lower({u}), '[-_/]', ' ', 'g'), '{w}') then {max(1, n // 2) if n > 0 else n} else 0 end" for w, n in SYLLABLES)


@query("link_scores", f"with {links_sql()} select page_id, pos, cast({_weighed('text', 'url')} as int) as score, cast({FIRST} as int) as first_score from links")
def link_scores(spark, d):
    x = links(spark, d)
    return x.select("page_id", F.col("pos").cast("long").alias("pos"), S.keyword_score(F.col("text"), F.col("url"), SYLLABLES).alias("score"), S.first_score(F.col("text"), F.col("url"), "results").alias("first_score"))


@query("link_sites", f"with {links_sql()} select page_id, pos, regexp_extract(url, '^https?://([^/?#]*)', 1) as host, regexp_extract(url, '([^./]*\\.[^./]*)(/|$)', 1) as site from links")
def link_sites(spark, d):
    x = links(spark, d)
    return x.select("page_id", F.col("pos").cast("long").alias("pos"), U.host(F.col("url")).alias("host"), U.registered_domain(F.col("url")).alias("site"))


@query("ranked_links", f"""with {links_sql()}, s as (select *, {_weighed('text', 'url')} as score, rtrim(url, '/') as site from links), b as (select page_id, site, max(score) as score, min(pos) as first_pos, arg_max(url, (score, -pos)) as url from s where score > 0 group by all)
    select page_id, row_number() over (partition by page_id order by score desc, length(url), first_pos) as rank, cast(score as int) as score, url from b qualify rank <= 6""")
def ranked_links(spark, d):
    return D.ranked_links(links(spark, d), "results", ["page_id"], weights=SYLLABLES).filter("rank <= 6").select("page_id", "rank", "score", "url")


@query("page_link_filter", f"with {links_sql()} select page_id, count(*) filter (trim(href) <> '' and not contains(href, '#') and not ends_with(lower(href), '.pdf')) as page_links, count(*) filter (not starts_with(href, '#')) as plain_links from links group by 1")
def page_link_filter(spark, d):
    x = links(spark, d)
    return x.groupBy("page_id").agg(F.count_if(S.is_page_link(F.col("href"), F.col("url"))).alias("page_links"), F.count_if(S.is_plain_link(F.col("href"), F.col("url"))).alias("plain_links"))


@query("url_parts", "select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) as host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path, regexp_replace(url, '#.*$', '') as bare, regexp_extract(url, '([^./]*\\.[^./:]*)(/|$|[?#])', 1) as site from pages")
def url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", U.host(u).alias("host"), U.path(u).alias("path"), U.without_fragment(u).alias("bare"), U.registered_domain(u).alias("site"))


@query("stable_urls", """select page_id, regexp_extract(url, '^([^?#]*)', 1) || case when page_id % 2 = 0 then '?page=' || page_id || '&q=a+b' else '' end as stable,
    'https://' || replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '-', '.') || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) || '?x=1' as unlaundered from pages""")
def stable_urls(spark, d):
    """URLs with parameters put on: volatile ones go; most of an odd page's are volatile, so all of them go."""
    p = table(spark, d, "pages")
    bare = F.regexp_extract("url", "^([^?#]*)", 1)
    more = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("?page="), F.col("page_id").cast("string"), F.lit("&ver=17&q=a%20b#top"))).otherwise(F.concat(F.lit("?page=1&ts=2&VER=3&s="), F.md5(F.col("url"))))
    proxy = F.concat(F.lit("http://"), F.replace(U.host(F.col("url")), F.lit("."), F.lit("-")), F.lit(".translate.goog"), U.path(F.col("url")), F.lit("?_x_tr_sl=en&x=1&_x_tr_tl=es#a"))
    return p.select("page_id", U.strip_cachebust(F.concat(bare, more)).alias("stable"), U.unlaunder(proxy).alias("unlaundered"))


@query("portal_urls", "select page_id, page_id % 3 = 0 as portal, page_id % 5 = 0 as laundered, page_id % 7 = 0 as bad from pages")
def portal_urls(spark, d):
    """Hosts in front of the pages' own paths: a statewide portal, the same behind a proxy, a directory."""
    own = U.path(F.col("url"))
    put = lambda n, h: F.when(F.col("page_id") % n == 0, F.concat(F.lit(f"https://{h}"), own)).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", U.is_generic_portal(put(3, "www.votetexas.gov")).alias("portal"), U.is_generic_portal(put(5, "www-vote411-org.example.net")).alias("laundered"), U.is_bad_host(put(7, "www.city-data.com")).alias("bad"))


@query("canonical_ids", """select doc_id, 'widgetFAQ(' || doc_id || ')GUID' as guid, 'tc-search-HEX' as hex, 'view--RANDOM' as token, 'pbckidHEX' as glued, 'ewd-' || doc_id || '-RANDOM' as suffix, 'wp-child-theme-a-b_BUILD' as build,
    case when regexp_matches(md5(cast(doc_id as varchar))[1:7], '[a-f]') then 'style-HEX' else 'style-' || md5(cast(doc_id as varchar))[1:7] end as style, 'at TIMESTAMP' as clock from documents""")
def canonical_ids(spark, d):
    """Identifiers made from each document's hash."""
    m = F.md5(F.col("doc_id").cast("string").cast("binary"))
    s = lambda a, n: F.substring(m, a, n)
    i = F.col("doc_id").cast("string")
    c = X.canon_ids
    guid = F.concat_ws("-", s(1, 8), s(9, 4), s(13, 4), s(17, 4), s(21, 12))
    return table(spark, d, "documents").select(
        "doc_id", c(F.concat(F.lit("widgetFAQ("), i, F.lit(")"), guid)).alias("guid"), c(F.concat(F.lit("tc-search-"), s(1, 13))).alias("hex"), c(F.concat(F.lit("view--Qz"), s(1, 8))).alias("token"), c(F.concat(F.lit("pbckid"), s(3, 15))).alias("glued"),
        c(F.concat(F.lit("ewd-"), i, F.lit("-MeFx"), s(1, 5))).alias("suffix"), c(F.concat(F.lit("wp-child-theme-a-b_"), i)).alias("build"), c(F.concat(F.lit("style-"), s(1, 7))).alias("style"), c(F.lit("at 2026-07-28 12:31:37")).alias("clock"),
    )


@query("canonical_texts", "select doc_id, '" + MONTHS[0] + " ' || (doc_id % 28 + 1) || ', 2026 EDGE_REF_REDACTED ' || sha256(text) as line from documents")
def canonical_texts(spark, d):
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    raw = F.concat(F.lit("Tue Jan "), day, F.lit(" 08:49:00 CDT 2026 18.4f78ce17.1784308058.1113f7d6 "), X.sha256(F.col("text")))
    return table(spark, d, "documents").select("doc_id", X.edge_references(X.plain_dates(raw)).alias("line"))


SHELL = " or ".join(f"contains(lower(text), '{w}')" for w in JS_SHELL)


def quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


CHECKED = f"p as (select doc_id, case when doc_id % 7 = 0 then [{', '.join(map(quoted, INTERSTITIAL))}][doc_id % {len(INTERSTITIAL)} + 1] || ' ' else '' end || text as text from documents)"


@query("page_predicates", f"with {CHECKED} select doc_id, ({SHELL}) or length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 500 as js_shell, " + " or ".join(f"contains(lower(left(text, 6000)), {quoted(w)})" for w in INTERSTITIAL) + " as interstitial, octet_length(encode(text)) as n_bytes, sha256(text) as sha from p")
def page_predicates(spark, d):
    """Every seventh document begins with one of the marks of a bot check."""
    k = F.col("doc_id")
    mark = F.element_at(F.array(*[F.lit(w) for w in INTERSTITIAL]), (k % len(INTERSTITIAL) + 1).cast("int"))
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).withColumn("text", F.concat(F.when(k % 7 == 0, F.concat(mark, F.lit(" "))).otherwise(""), "text"))
    t = F.col("text")
    return docs.select("doc_id", R.is_js_shell(t, t).alias("js_shell"), R.is_interstitial(t).alias("interstitial"), X.byte_size(t).alias("n_bytes"), X.sha256(t).alias("sha"))


@query("text_lines", "with l as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as k from documents), c as (select doc_id, k, trim(regexp_replace(x, '\\s+', ' ', 'g')) as x from l) select doc_id, sha256(coalesce(string_agg(x, chr(10) order by k) || chr(10), '')) as sha from c where x <> '' group by 1")
def text_lines(spark, d):
    return table(spark, d, "documents").filter("trim(text) <> ''").select("doc_id", X.sha256(X.text_lines(F.col("text"))).alias("sha"))


@query("name_slugs", "select c_custkey, regexp_replace(lower(c_name || ' & ' || c_mktsegment), '[^a-z0-9]', '', 'g') as squashed, regexp_replace(lower(c_name || ' & ' || c_mktsegment), '[^a-z0-9]+', '-', 'g') as hyphened from customer")
def name_slugs(spark, d):
    n = F.concat_ws(" & ", "c_name", "c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", X.squashed(n).alias("squashed"), X.hyphened(n).alias("hyphened"))


@query("candidate_urls", """with c as (select c_custkey, case when c_custkey % 2 = 0 then c_mktsegment || c_custkey else c_name end as name from customer),
    n as (select c_custkey, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as s, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as h from c)
    select c_custkey, case when s = h then 14 else 16 end as n_urls, 'https://www.co.' || s || '.tx.us/' as first_url, 'https://' || case when s = h then 'www.' || s || 'countytx.gov' else 'www.co.' || h || '.tx.us' end || '/' as third_url, 'https://www.' || s || 'countytx.org/' as last_url from n""")
def candidate_urls(spark, d):
    """Customers' names have a hyphen; segments with a number have none."""
    k = F.col("c_custkey")
    u = U.candidate_urls(F.when(k % 2 == 0, F.concat("c_mktsegment", k.cast("string"))).otherwise(F.col("c_name")))
    return table(spark, d, "customer").select("c_custkey", F.size(u).alias("n_urls"), u[0].alias("first_url"), u[2].alias("third_url"), F.element_at(u, -1).alias("last_url"))


@query("audited_documents", "with k as (select doc_id, lower(coalesce(source, '') || chr(10) || text) as hay, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) as n, " + "(" + " or ".join(f"contains(lower(coalesce(source, '') || chr(10) || text), '{w}')" for w in BAD_PAGE) + """) as bad, lang from documents),
    i as (select *, contains(hay, 'th' || (doc_id % 10)) or contains(hay, 'the') as identity from k)
    select doc_id, case when bad then 'uncertain' when identity and contains(hay, 'county') then case when n < 200 then 'likely' else 'confident' end when identity then 'likely' else 'uncertain' end as confidence from i""")
def audited_documents(spark, d):
    """Documents as homepages of the county "The"."""
    a = R.audit_content(F.lit("The"), F.lit("Of"), F.lit("homepage"), F.col("text"), F.col("source"), F.lit("https://x.gov/"), F.lit("https://x.gov/"))
    return spread(table(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id", a["confidence"].alias("confidence"))


GOV_SQL = " + ".join(f"cast(contains(lower(text), '{w.replace(chr(39), chr(39) * 2)}') as int)" for w in GOV)


@query("keyword_hits", f"select doc_id, cast({GOV_SQL} as int) as gov from documents")
def keyword_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(R.hits(F.lower("text"), GOV)).alias("gov"))


@query("documents_beside_labels", "select quality, toxic, count(*) as n, count(distinct sha256(text)) as texts from documents join labels using (doc_id) group by all")
def documents_beside_labels(spark, d):
    h = H.text_hashes(table(spark, d, "documents"), "text")
    return h.join(table(spark, d, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.countDistinct("text_sha256").alias("texts"))


LINES = "x as (select l_orderkey, l_linenumber, min(l_suppkey) as l_suppkey from lineitem group by all)"
TRIED = LINES + ", t as (select l_orderkey as county, l_linenumber as priority, case l_suppkey % 4 when 0 then 'confident' when 1 then 'likely' else 'reject' end as confidence from x)"


def lines(spark, d):
    """Lines of orders; a number that an order repeats counts once."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"))


def tried(spark, d):
    s = F.col("l_suppkey") % 4
    return lines(spark, d).select(F.col("l_orderkey").alias("county"), F.col("l_linenumber").alias("priority"), F.when(s == 0, "confident").when(s == 1, "likely").otherwise("reject").alias("confidence"))


PROBED = LINES + """, p as (select l_orderkey as county, l_linenumber as priority, l_suppkey as s, case l_suppkey % 8 when 0 then 'dns_fail' when 1 then 'fetch_fail:timeout' when 2 then 'http_404' when 3 then 'likely' when 4 then 'confident' else 'reject' end as result from x),
    f as (select county, min(case when result = 'confident' then priority end) as sure, min(case when result = 'likely' then priority end) as likely from p group by 1),
    m as (select p.* from p join f using (county) where priority <= coalesce(sure, priority)),
    l as (select county, string_agg(result || ' ' || coalesce(case when s % 8 > 2 then '200 https://www.s' || s || '.example.org/ T' || s || ' e' || s end, ''), ';' order by priority) as attempts from m group by 1)"""


@query("resolved_counties", f"""with {PROBED}, b as (select o_orderkey as county, coalesce(sure, likely) as pick, sure from (select distinct o_orderkey from orders) o left join f on county = o_orderkey)
    select b.county, case when pick is null then '' else 'https://www.s' || s || '.example.org/' end as homepage, case when pick is null then 'unresolved' when sure is null then 'likely' else 'confident' end as confidence,
    case when pick is null then 'no candidate pattern verified — needs web search' else 'e' || s end as evidence, 'T' || s as title, coalesce(attempts, '') as attempts
    from b left join p on p.county = b.county and p.priority = b.pick left join l on l.county = b.county""")
def resolved_counties(spark, d):
    """Orders as counties, their lines as candidates: the whole log of attempts, and the counties for which none was found."""
    s = F.col("l_suppkey")
    named = lambda a, b="": F.concat(F.lit(a), s.cast("string"), F.lit(b))
    tries = lines(spark, d).select(
        F.col("l_orderkey").alias("county"), F.col("l_linenumber").alias("priority"), named("https://s", ".example.org/").alias("url"), (s % 8 != 0).alias("resolves"), (s % 8 != 1).alias("ok"), F.when(s % 8 == 1, "timeout").alias("error"),
        F.when(s % 8 == 2, 404).otherwise(200).alias("http_status"), F.when(s % 8 == 3, "likely").when(s % 8 == 4, "confident").otherwise("reject").alias("confidence"), named("e").alias("evidence"), named("https://www.s", ".example.org/").alias("final_url"), named("T").alias("title"),
    )
    counties = table(spark, d, "orders").select(F.col("o_orderkey").alias("county")).distinct()
    told = F.transform("attempts", lambda a: F.concat(a["result"], F.lit(" "), F.concat_ws(" ", a["status"].cast("string"), a["final_url"], a["title"], a["evidence"])))
    return D.resolved(counties, D.attempt_results(tries)).withColumn("attempts", F.array_join(told, ";"))


@query("stabilized_urls", """select page_id, case page_id % 3 when 0 then 'https://results.enr.clarityelections.com/TX/C' || page_id || '/'
    when 1 then 'https://www.c' || page_id || '.example.org/a?b=' || page_id else url end as url from pages""")
def stabilized_urls(spark, d):
    """Deep links into a results application, proxied pages, and the pages' own URLs, which stay."""
    n = F.col("page_id").cast("string")
    deep = F.concat(F.lit("https://results.enr.clarityelections.com/TX/C"), n, F.lit("/"), (F.col("page_id") % 97).cast("string"), F.lit("/web."), n, F.lit("/#/summary?v="), n)
    proxied = F.concat(F.lit("https://www-c"), n, F.lit("-example-org.translate.goog/a?b="), n, F.lit("&_x_tr_sl=en#top"))
    url = F.when(F.col("page_id") % 3 == 0, deep).when(F.col("page_id") % 3 == 1, proxied).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", U.stabilized(url).alias("url"))


@query("first_confident", f"with {TRIED} select county, min(case when confidence = 'confident' then priority end) is not null as sure, coalesce(min(case when confidence = 'confident' then priority end), min(case when confidence = 'likely' then priority end)) as priority from t group by 1 having coalesce(min(case when confidence = 'confident' then priority end), min(case when confidence = 'likely' then priority end)) is not null")
def first_confident(spark, d):
    return D.first_confident(tried(spark, d)).select("county", (F.col("confidence") == "confident").alias("sure"), "priority")


@query("until_confident", f"with {TRIED}, f as (select county, min(case when confidence = 'confident' then priority end) as p from t group by 1) select county, count(*) as n_tried from t join f using (county) where p is null or priority <= p group by 1")
def until_confident(spark, d):
    return D.until_confident(tried(spark, d)).groupBy("county").agg(F.count("*").alias("n_tried"))


@query("first_valid_candidate", f"""with {LINES}, t as (select l_orderkey as county, l_linenumber as rank, l_suppkey % 4 as s from x where l_linenumber <= 4) select county, min(case when s = 0 then rank end) as rank, least(3, count(*) filter (s <> 0)) as failed from t group by 1""")
def first_valid_candidate(spark, d):
    """An order's lines are candidates by rank; suppliers' captures tell which can be taken."""
    x = lines(spark, d)
    ranked = x.select(F.col("l_orderkey").alias("county"), F.col("l_linenumber").alias("rank"), F.lit(1).alias("score"), F.concat(F.lit("http://s/"), F.col("l_suppkey").cast("string")).alias("url"))
    s = F.col("s_suppkey") % 4
    caps = table(spark, d, "supplier").select(F.concat(F.lit("http://s/"), F.col("s_suppkey").cast("string")).alias("requested_url"), (s != 1).alias("ok"), F.when(s == 2, 404).otherwise(200).alias("http_status"), F.when(s == 3, "application/pdf").otherwise("text/html").alias("content_type"), F.lit("http://s/").alias("final_url"))
    v = D.first_valid(ranked, caps, ["county"])
    return v.select("county", F.col("pick.rank").alias("rank"), F.size("tried").cast("long").alias("failed"))
