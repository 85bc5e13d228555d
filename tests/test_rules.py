"""Rules on inline rows: identity, canonical values, URLs, audit."""

import pytest
from pyspark.sql import functions as F

from pagetide.functions import rules, scoring, urls, values
from pagetide.operators import captures, discovery, history, html


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


PAD = " The county courthouse, county clerk and sheriff serve the public. " * 5
IDENTITY = [
    ("Houston", "Crockett", "https://www.harriscountytx.gov/", "Harris County, Texas government in Houston" + PAD, "Harris County, TX", "reject"),
    ("Harris", "Houston", "https://www.harriscountytx.gov/", "Harris County, Texas government in Houston" + PAD, "Harris County, TX", "confident"),
    ("Tyler", "Woodville", "https://www.smith-county.com/", "Smith County, Texas, seat Tyler" + PAD, "Smith County, Texas", "reject"),
    ("Smith", "Tyler", "https://www.smith-county.com/", "Smith County, Texas, seat Tyler" + PAD, "Smith County, Texas", "confident"),
    ("Deaf Smith", "Hereford", "https://www.co.deaf-smith.tx.us/", "Deaf Smith County, Hereford, Texas" + PAD, "Deaf Smith County, Texas", "confident"),
    ("Smith", "Tyler", "https://www.co.deaf-smith.tx.us/", "Deaf Smith County, Hereford, Texas" + PAD, "Deaf Smith County, Texas", "reject"),
    ("Travis", "Austin", "https://www.traviscountytx.gov/", "Travis County, Austin, Texas. Ann Brown\nCounty Clerk" + PAD, "Travis County, Texas", "confident"),
    ("Burnet", "Burnet", "https://www.burnetcountytx.com/", "Burnet County, Texas process server for hire" + " serving papers" * 20, "Burnet County, Texas Process Servers", "reject"),
    ("Anderson", "Palestine", "https://www.andersoncountysc.org/", "Anderson County, South Carolina" + PAD, "Anderson County South Carolina", "reject"),
    ("Anderson", "Palestine", "https://www.andersoncounty.com/", "This domain is for sale", "Domain for sale: buy this domain", "reject"),
]


def test_identity(spark):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(IDENTITY)], "id int, county string, seat string, url string, text string, title string, expected string")
    names = spark.createDataFrame([(n,) for n in ("Houston", "Harris", "Tyler", "Smith", "Deaf Smith", "Travis", "Brown", "Burnet", "Anderson")], "county string")
    others = discovery.other_counties(df, names, "id")
    none = F.array().cast("array<string>")
    v = rules.verify(F.col("county"), F.col("seat"), F.col("url"), F.col("text"), F.col("title"), F.coalesce("others", none))
    for r in df.join(others, "id", "left").select("*", v.alias("v")).collect():
        assert r["v"]["confidence"] == r["expected"], (r["county"], r["v"])


CANONICAL = [
    ("widgetFAQ(194)a6fb6078-ff97-47b6-9809-b9598800536b", "widgetFAQ(194)GUID"),
    ("tc-search-6a68ccbc3ce9d", "tc-search-HEX"),
    ("meetings-and-events-view--pPh8W-F6LrM", "meetings-and-events-view--RANDOM"),
    ("pbckid6a6a382fdf001", "pbckidHEX"),
    ("ewd-ufaq-post-308-MeFxb5jB1A", "ewd-ufaq-post-308-RANDOM"),
    ("wp-child-theme-jefferson-tx-redesign_102", "wp-child-theme-jefferson-tx-redesign_BUILD"),
    ("style-9bc41b9", "style-HEX"),
    ("post-123456", "post-123456"),
    ("2026-07-28 12:31:37", "TIMESTAMP"),
    ("7/22/2026 12:27:59 PM", "TIMESTAMP"),
]


@pytest.mark.parametrize(("value", "expected"), CANONICAL)
def test_canonical_values_in_both_forms(spark, value, expected):
    assert one(spark, values.canon_ids(F.lit(value))) == expected
    assert values.python_canon_ids(value) == expected


def test_dates_and_references(spark):
    raw = "x Tue Jul 28 08:49:00 CDT 2026 y 18.4f78ce17.1784308058.1113f7d6"
    expected = "x July 28, 2026 y EDGE_REF_REDACTED"
    assert one(spark, values.edge_references(values.plain_dates(F.lit(raw)))) == expected
    assert html.canonical(raw) == expected


URLS = [
    ("https://a.org/p?ver=1&page=2#top", "https://a.org/p?page=2"),
    ("https://a.org/p?ver=1&v=2&x=3", "https://a.org/p"),
    ("https://a.org/p#top", "https://a.org/p#top"),
    ("https://a.org/p?", "https://a.org/p?"),
    ("https://a.org/p?s=6a68ccbc3ce9d1&page=2", "https://a.org/p?page=2"),
]


@pytest.mark.parametrize(("url", "expected"), URLS)
def test_cache_parameters_in_both_forms(spark, url, expected):
    assert one(spark, urls.strip_cachebust(F.lit(url))) == expected
    assert urls.stable_query(url) == expected


def test_sites(spark):
    assert one(spark, urls.registered_domain(F.lit("https://www.co.polk.tx.us"))) == "polk.tx.us"
    assert one(spark, urls.registered_domain(F.lit("https://www.co.polk.tx.us/"))) == "tx.us"
    assert one(spark, urls.unlaunder(F.lit("https://www-votepolk-gov.translate.goog/early?_x_tr_sl=en&a=1#x"))) == "https://www.votepolk.gov/early?a=1"
    assert one(spark, urls.stabilized(F.lit("https://results.enr.clarityelections.com/TX/Polk/124/web.3/"))) == "https://results.enr.clarityelections.com/TX/Polk/"
    assert one(spark, urls.is_generic_portal(F.lit("https://www-vote411-org.translate.example/x")))
    assert one(spark, urls.redirected_to_root(F.lit("https://a.org/deep/page"), F.lit("https://a.org/")))
    assert not one(spark, urls.redirected_to_root(F.lit("https://a.org/"), F.lit("https://a.org/")))


def test_link_scores(spark):
    score = lambda t, u, p="elections": one(spark, scoring.link_score(F.lit(t), F.lit(u), p))
    assert score("Elections", "https://a.org/x") == 6 + 6 + 8
    assert score("Vote", "https://votepolk.gov/") == 3 + 8 + 12
    assert score("More", "https://a.org/early-voting", "early_voting") == 5  # half of 11


def test_audit_ladder(spark):
    def audit(text, title="Polk County", kind="elections", final="https://a.org/e", asked="https://a.org/e"):
        return one(spark, rules.audit_content(F.lit("Polk"), F.lit("Livingston"), F.lit(kind), F.lit(text), F.lit(title), F.lit(final), F.lit(asked)))

    long = " information for residents" * 10
    assert audit("election office" + long)["confidence"] == "confident"
    assert audit("election office")["reason"].startswith("thin content (15 chars)")
    assert audit("page not found election" + long)["flag"]
    assert audit("vote here" + long)["confidence"] == "likely"
    assert audit("election" + long, final="https://a.org/")["confidence"] == "uncertain"


def test_attempts(spark):
    rows = [("a", True, 1, True, 500, None), ("a", True, 2, True, 403, None), ("a", False, 1, True, 200, None), ("b", True, 1, True, 500, None), ("b", True, 2, True, 503, None), ("b", False, 1, False, None, "x"), ("c", True, 1, False, None, "t1"), ("c", False, 2, False, None, "t2")]
    df = spark.createDataFrame(rows, "url string, http2 boolean, attempt int, ok boolean, http_status int, error string")
    got = {r["url"]: (r["http_status"], r["error"]) for r in captures.arbitrated(df, ["url"]).collect()}
    assert got == {"a": (200, None), "b": (503, None), "c": (None, "plain_fetch_error: t2")}


def test_run_diff_knows_deletions(spark):
    s = "county string, page_type string, html_sha256 string, text_sha256 string"
    old = spark.createDataFrame([("a", "x", "1", "1"), ("b", "x", "1", "1"), ("c", "x", "1", "1")], s)
    new = spark.createDataFrame([("a", "x", "1", "1"), ("b", "x", "2", "1"), ("d", "x", "1", "1")], s)
    assert {(r["county"], r["status"]) for r in history.run_diff(old, new, ["county", "page_type"]).collect()} == {("b", "M"), ("c", "D"), ("d", "A")}
