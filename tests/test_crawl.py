"""The crawl on odd input; the registered query holds it against SQL."""

from pagetide.operators.crawl import crawl

CAPTURES = "requested_url string, path string, ok boolean, http_status int, content_type string, final_url string, error string"
LINKS = "page_url string, path string, pos long, text string, url string"


def rows(spark, homepages, captures, links):
    df = crawl(spark.createDataFrame(homepages, "county string, batch string, homepage string"), spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(links, LINKS))
    return {(r["county"], r["page_type"]): (r["url"], r["notes"], r["why"]) for r in df.collect()}


def page(url, path="plain"):
    return (url, path, True, 200, "text/html", url, None)


def test_no_captures_and_no_homepage(spark):
    got = rows(spark, [("Polk", "2", "https://www.polk.org"), ("Smith", "2", " ")], [], [])
    assert len(got) == 4 and {v[0] for v in got.values()} == {""} and {v[2] for v in got.values()} == {"homepage"}


def test_second_candidate_and_repeated_captures(spark):
    h = "https://www.polk.org"
    links = [(h, "plain", 1, "Elections", f"{h}/gone"), (h, "plain", 2, "Elections Office", f"{h}/pdf"), (h, "plain", 3, "Voting", f"{h}/voting"), (h, "plain", 5, "Voting", f"{h}/voting/"), (h, "plain", 4, None, None)]
    captures = [page(h), page(h), (f"{h}/pdf", "plain", True, 200, "application/pdf", f"{h}/pdf", None), page(f"{h}/voting")]
    got = rows(spark, [("Polk", "2", h)], captures, links)
    assert got["Polk", "elections"] == (f"{h}/voting", 'found via "Voting" score=13', "homepage link")
    assert got["Polk", "results"] == ("", "GAP: no distinct page found (likely folded into elections page)", "none")
