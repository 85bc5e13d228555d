"""The crawl over sites derived from the customer table: each customer is a county with a site of one of ten kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.crawl import crawl
from .inputs import spread, table
from .registry import query

H, V = "https://www.county{k}.org", "https://www.votecounty{k}.org"
#: kind -> links (page, path, pos, text, url); {k} is the customer's key
LINKS = {
    1: [(H, "plain", 1, "Elections", H + "/elections"), (H + "/elections", "plain", 1, "Polling Locations", H + "/polling"), (H + "/elections", "plain", 2, "Early Voting", H + "/early"), (H + "/elections", "plain", 3, "Election Results", H + "/results")],
    2: [(H, "plain", 1, "Elections", H + "/old"), (H, "plain", 2, "Voter Information", H + "/voters")],
    3: [(H, "headless", 1, "Elections", H + "/elections"), (H + "/elections", "plain", 1, "Current Election", H + "/current"), (H + "/current", "plain", 1, "Polling Place", H + "/place")],
    4: [(H, "plain", 1, "Departments", H + "/departments"), (H + "/departments", "plain", 1, "Elections Office", H + "/clerk"), (H + "/clerk", "plain", 1, "Where to vote", "https://www.other.com/precincts"), (H + "/clerk", "plain", 2, "Results", H + "/canvass")],
    6: [(H, "plain", 1, "Elections", H + "/1021"), (H + "/1021", "plain", 1, "Go", V + "/"), (V + "/", "plain", 1, "Polling Locations", V + "/polling"), (V + "/", "plain", 2, "Early Voting", V + "/early")],
    7: [(H, "plain", 1, "Elections", H + "/e404")],
    8: [(H, "plain", 1, "Elections", H + "/elections"), (H + "/elections", "plain", 1, "Early Voting", H + "/early"), (H + "/elections", "plain", 2, "General Election", H + "/general")],
    9: [(H, "plain", 1, "Elections", H + "/elections"), (H + "/elections", "plain", 1, "Precinct Map", H + "/precinct")],
}
#: kind -> what a capture gave (url, path, status, content type, final url) where it is not a page of status 200 that stays where it is
CAPTURES = {2: [(H + "/old", "plain", 404, "text/html", H + "/old")], 4: [(H + "/canvass", "plain", 200, "application/pdf", H + "/canvass")], 7: [(H + "/e404", "plain", 404, "text/html", H + "/e404")], 8: [(H + "/early", "plain", 200, "text/html", "https://www.votetexas.gov/early")]}
FOLDED, NONE, DOWN = "GAP: no distinct page found (likely folded into elections page)", "GAP: no distinct page found", "GAP: could not crawl — homepage blocked/unreachable (timeout); needs manual URL discovery"
HUB = "no standing {t} page; using per-election hub page (shared with other types) — review"
#: kind -> what must come out, by page type in order: url, notes, why
EXPECTED = {
    0: [("", DOWN, "homepage")] * 4,
    1: [(H + "/elections", 'found via "Elections" score=20', "homepage link"), (H + "/polling", 'found via "Polling Locations" score=21', "link"), (H + "/early", 'found via "Early Voting" score=11', "link"), (H + "/results", 'found via "Election Results" score=21', "link")],
    2: [(H + "/voters", 'found via "Voter Information" score=11', "homepage link"), *[("", FOLDED, "none")] * 3],
    3: [(H + "/elections", 'found via "Elections" score=20', "rendered homepage"), (H + "/place", 'found via "Polling Place" score=21', "link"), (H + "/current", HUB, "hub page"), ("", FOLDED, "none")],
    4: [(H + "/clerk", 'found via "Elections Office" score=28', "department page"), ("", "GAP: no county-specific page found", "none"), ("", FOLDED, "none"), ("", "GAP: candidate is non-HTML", "none")],
    5: [("", "GAP: no working elections page found", "none"), *[("", NONE, "none")] * 3],
    6: [(V + "/", "dedicated elections portal, reached via 1021", "portal"), (V + "/polling", 'found via "Polling Locations" score=19', "link"), ("", "GAP: candidate unreachable", "none"), ("", FOLDED, "none")],
    7: [("", "GAP: no working elections page found (tried: e404 -> candidate unreachable)", "none"), *[("", NONE, "none")] * 3],
    8: [(H + "/elections", 'found via "Elections" score=20', "homepage link"), (H + "/general", HUB, "hub page"), (H + "/general", HUB, "hub page"), ("", FOLDED, "none")],
    9: [(H + "/elections", 'found via "Elections" score=20', "homepage link"), (H + "/precinct", 'found via "Precinct Map" score=5 (weak match — review)', "link"), ("", FOLDED, "none"), ("", FOLDED, "none")],
}
UNSEEN = {V + "/early", "https://www.other.com/precincts"}
KINDS = 10


def sites(spark, d):
    """homepages, captures, links of all counties."""
    c = spread(table(spark, d, "customer")).select("c_custkey", (F.col("c_custkey") % KINDS).cast("int").alias("kind"), F.col("c_name").alias("county"))
    keyed = lambda x: F.replace(x, F.lit("{k}"), F.col("c_custkey").cast("string"))
    homepages = c.select("county", F.lit("1").alias("batch"), keyed(F.lit(H)).alias("homepage"))
    links = [(kind, *row) for kind, rows in LINKS.items() for row in rows] + [(kind, H, "plain", 0, "About us", H + "/about") for kind in range(KINDS)]
    odd = [(kind, *row) for kind, rows in CAPTURES.items() for row in rows] + [(0, H, "plain", None, None, None)]
    known = {r[:3] for r in odd}
    pages = {(kind, H, "plain") for kind in range(KINDS)} | {(3, H, "headless")} | {(k, u, "plain") for k, *_, u in links}
    even = [(k, u, p, 200, "text/html", u) for k, u, p in sorted(pages) if (k, u, p) not in known and u not in UNSEEN]
    links = spark.createDataFrame(links, "kind int, page_url string, path string, pos long, text string, url string")
    captures = spark.createDataFrame(odd + even, "kind int, requested_url string, path string, http_status int, content_type string, final_url string")
    links = c.join(F.broadcast(links), "kind").select(keyed(F.col("page_url")).alias("page_url"), "path", "pos", "text", keyed(F.col("url")).alias("url"))
    captures = c.join(F.broadcast(captures), "kind").select(
        keyed(F.col("requested_url")).alias("requested_url"), "path", F.col("http_status").isNotNull().alias("ok"), "http_status", "content_type",
        keyed(F.col("final_url")).alias("final_url"), F.when(F.col("http_status").isNull(), "timeout").alias("error"),
    )
    return homepages, captures, links


TYPES = ["elections", "polling", "early_voting", "results"]
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_rows = ", ".join(f"({kind}, '{t}', {_quoted(u)}, {_quoted(n.replace('{t}', t))}, '{w}')" for kind, rows in EXPECTED.items() for t, (u, n, w) in zip(TYPES, rows, strict=True))


@query("crawled_draft", f"""select c_name as county, '1' as batch, page_type, replace(u, '{{k}}', cast(c_custkey as varchar)) as url, case when u like 'https://www.vote%' then 'true' else 'false' end as external, notes, why
    from customer join (values {_rows}) e(kind, page_type, u, notes, why) on kind = c_custkey % {KINDS}""")
def crawled_draft(spark, d):
    """The draft of all counties, with the step that each row comes from."""
    return crawl(*sites(spark, d))
