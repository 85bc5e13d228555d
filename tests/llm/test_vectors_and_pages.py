"""Neighbours and main texts."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagetide.llm import html, neighbours


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 16)).astype(np.float32)
    x[100:160] = x[100] + rng.normal(size=(60, 16)).astype(np.float32) * 0.001
    df = spark.createDataFrame([(i, [float(z) for z in v], "a", 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, leaf string, tree int")
    got = neighbours.nearest(df).toPandas()
    y, hit = x.astype(float), 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        hit += len(set(np.lexsort((np.arange(4000), d))[:10]) & set(g["vec_id"]))
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11)) and np.array_equal(d[g["vec_id"]], g["score"])
    assert hit / 400 >= 0.9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_query_on_its_own_table(spark, sf):
    got = neighbours.op5_neighbours(spark, f"/root/testdata/{sf}").toPandas()
    t = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
    x, ids, hit = np.stack(t["embedding"]).astype(float), t["vec_id"].to_numpy(), 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hit += len(set(ids[np.lexsort((ids, d))[:10]]) & set(g["vec_id"]))
    assert hit / len(got) >= 0.9 and got["query_id"].nunique() == (ids % 100 == 0).sum()


def test_blocks_of_queries_and_parts_of_leaves_change_nothing(spark, monkeypatch):
    """Ids that are all multiples of a number of parts, one id on a third of the rows, and far smaller groups."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 8))
    rows = [(100 if k % 3 == 0 else 12 * k, x[k].tolist()) for k in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [tuple(r) for r in neighbours.nearest(df).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(neighbours, "PART_ROWS", 37)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 7)
    assert [tuple(r) for r in neighbours.nearest(df).orderBy("query_id", "rank").collect()] == whole and len(whole) > 300


def shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_rows_are_sent_once_however_many_leaves_queries_open(spark):
    rng = np.random.default_rng(5)
    n = 4000
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(n)], "vec_id long, embedding array<double>").cache()
    df.count()
    before = shuffled(spark)
    assert neighbours.nearest(df).count() == 10 * n // 100
    # rows once, and once for the sample; queries once to each part; ten of each query from each part. By leaves it was 65,853
    assert shuffled(spark) - before < 3 * n + 12 * 32 * n // 100


def test_contenders_hold_the_nearest_of_close_and_huge_vectors():
    rng = np.random.default_rng(6)
    base = rng.normal(size=(1, 16))
    for x in (base + 1e-9 * rng.normal(size=(400, 16)), np.repeat(base, 400, 0), 1e200 * rng.normal(size=(400, 16)), 1e-170 * rng.normal(size=(400, 16)), rng.normal(size=(400, 16)) * 10.0 ** rng.integers(-8, 8, (400, 1))):
        q, may = x[:70:2], rng.random((35, 400)) < 0.7
        with np.errstate(over="ignore"):
            d = np.sqrt(((x[None] - q[:, None]) ** 2).sum(2))
            got = neighbours.contenders(q, x, (x * x).sum(1), may, 10)
        d[~may] = np.inf
        for k in range(len(q)):
            tenth = np.sort(d[k])[9]
            assert got[k][may[k] & (d[k] <= tenth)].all() and not got[k][~may[k]].any()
    q, x = rng.normal(size=(64, 16)), rng.normal(size=(400, 16))
    assert neighbours.contenders(q, x, (x * x).sum(1), np.ones((64, 400), bool), 10).sum() == 640


def test_rows_seen_by_leaves():
    rng = np.random.default_rng(7)
    opened, at = (rng.random((50, 3, 8)) < 0.2).astype(np.uint8), rng.integers(0, 8, (200, 3)).astype(np.int16)
    got = neighbours.seen(opened, at)
    for q in range(50):
        assert [(int(x) >> q) & 1 for x in got] == [int(any(opened[q, t, at[r, t]] for t in range(3))) for r in range(200)]


def test_small_and_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, score double"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0.0), (1, [1.0, 0.0], 0.0), (2, [0.0, 1.0], 0.0), (3, [0.0, 0.0], 0.0), (4, None, 0.0), (5, [nan, 1.0], 0.0), (6, [inf, 1.0], 0.0), (7, [None, 1.0], 0.0), (None, [1.0, 1.0], 0.0), (8, [1.0, 0.0], 0.0), (8, [3.0, 0.0], 0.0), (100, [2.0, 0.0], 0.0), (9, [1.0], 0.0)]
    got = [tuple(r) for r in neighbours.nearest(spark.createDataFrame(rows, schema)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 8, 0.0), (0, 3, 100, 1.0), (0, 4, 2, 2**0.5), (100, 1, 0, 1.0), (100, 2, 1, 1.0), (100, 3, 8, 1.0), (100, 4, 2, 5**0.5)]
    assert neighbours.nearest(spark.createDataFrame([], schema)).collect() == []


ARTICLE = "<div class='post p{n}'><h1>Title {n}</h1><p>First para &amp; more, with   blanks\nand lines<p>Second <b>bold</b> <a href='/x'>link</a> para, long enough to count as text.</div>"
FRAME = "<html><body class='has-sidebar'><div class='nav'><a href='/'>Home</a></div>{notice}{article}<div id='comments'><p>A reader says a lot here, more than the article even, again and again and again and again.</p></div><div class='footer'>&copy; us</div><script>var t='</p>';</script></body></html>"


def test_consensus_finds_the_article(spark):
    rows = [(n, f"https://h.org/{n}", FRAME.format(article=ARTICLE.format(n=n), notice="")) for n in range(12)]
    rows.append((99, "https://h.org/99", FRAME.format(article="<div class='post p99'><p>Tiny.</p></div>", notice="<div class='box'>" + "<p>Something else entirely that is long.</p>" * 9 + "</div>")))
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in html.main_texts(df).collect()}
    assert got[3]["text"] == "Title 3\nFirst para & more, with blanks and lines\nSecond bold link para, long enough to count as text."
    assert got[3]["n_chars"] == len(got[3]["text"])
    assert got[99]["text"] == "Tiny."


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "not a url", ""), (3, "http://a.org/", "plain words"), (4, "http://a.org/", "<p>" * 3000 + "deep"), (5, "http://b.org", "<a " + '"' * 5000), (None, "http://a.org/", "<div><p>x</p></div>"), (3, "http://a.org/", "plain words"), (6, "http://c.org", "<!-- open"), (7, "http://d.org", "<script>never closed")]
    got = html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = [(r["page_id"], r["text"]) for r in got]
    assert len(got) == len(rows) and by.count((3, "plain words")) == 2
    assert {1: "", 2: "", 4: "deep", 6: "", 7: "", None: "x"}.items() <= dict(by).items()
    assert html.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


PROSE = "Many words of an article that are long enough to count as its text, and more of them. "


def text_by_itself(source):
    page = html.Page(source)
    return page.main_text([p for p, _ in sorted(page.votes(), key=lambda v: (-v[1], v[0]))[:5]])


def test_all_containers_of_an_article_count():
    nav = "<nav><a href='/'>Home</a></nav>"
    p = lambda n, k: f"<p>{k} {PROSE * n}</p>"
    for inner in (
        f"<h1>Title</h1>{p(1, 'lead')}<div class=content>{p(9, 'body')}</div>",
        f"<h1>Title</h1><div class='part a'>{p(9, 'lead')}</div><div class='part b'>{p(4, 'body')}</div><section class=c>{p(5, 'more')}</section>",
        f"<h1>Title</h1>{p(1, 'lead')}<table><tr><td>{PROSE * 9}<td>body<tr><td>{PROSE}<td>y</table>",
    ):
        for frame in ("<article>{}</article>", "<div class=post>{}</div>", "<main>{}</main>"):
            got = text_by_itself(f"<html><body>{nav}<div id=page>{frame.format(inner)}</div><div id=sidebar>{p(3, 'aside')}</div></body></html>")
            assert got.startswith("Title\nlead") and "body" in got and "aside" not in got and "Home" not in got, (frame, inner, got)


def test_a_hint_on_what_holds_the_page_does_not_lose_it():
    article = f"<div class=post><h1>Title</h1><p>{PROSE * 5}</p></div><div id=comments><p>{PROSE * 3} reader</p></div><div class=sidebar>aside</div>"
    for around in ("class='layout with-sidebar'", "class=no-ads", "id=header-and-main", "class=search-result"):
        got = text_by_itself(f"<html><body><div {around}>{article}</div></body></html>")
        assert got.startswith("Title\nMany") and "reader" not in got and "aside" not in got, (around, got)
    for head in ("<header class='entry-header'><h1>Title</h1></header>", "<div class='post-header'><h2>Title</h2></div>"):
        for tag in ("article", "div"):
            got = text_by_itself(f"<body><{tag} class=x>{head}<p>{PROSE * 5}</p></{tag}><div class=related><article>{PROSE}other</article></div></body>")
            assert got.startswith("Title\nMany") and "other" not in got, (head, tag, got)
    assert text_by_itself(f"<body><div class=comments><p>{PROSE}</p></div></body>") == PROSE.strip()
    assert text_by_itself(f"<body><form><div><p>{PROSE}</p></div></form></body>") == PROSE.strip()


def test_deep_and_broken_pages_take_seconds():
    began = time.time()
    assert html.Page("<div>x " * 100_000).main_text([]).count("x") == 100_000
    assert html.Page("<a " * 400_000).main_text([]).startswith("<a")
    assert html.Page("<b>" * 100_000 + "<p>x" * 1000).main_text([]).count("x") == 1000
    assert html.Page("<div>" * 50_000 + "</x>" * 50_000 + "t").main_text([]) == "t"
    assert html.Page("x<!-- abc <p>y").main_text([]) == "x" and html.Page("x <p>y</p> <! abc z").main_text([]) == "x\ny"
    assert time.time() - began < 30


@pytest.mark.parametrize("wrap", ["<div class='layout with-sidebar'>{}</div>", "<div class='layout no-sidebar'><main>{}</main></div>", "<div id='page' class='no-header'>{}</div>", "<form id='aspnetForm'>{}</form>", "<section class='related-content tags'>{}</section>", "<article><div class='article-header'><h1>Head</h1></div>{}</article>"])
def test_wrappers_with_hints_do_not_lose_the_article(wrap):
    text = html.Page("<html><body>" + wrap.format("<p>A first paragraph of the article.</p><p>And a second one, some longer.</p>") + "<div class='footer'>us</div></body></html>").main_text([])
    assert "A first paragraph of the article.\nAnd a second one, some longer." in text and "us" not in text.split("\n")
    assert ("Head" in text) == ("Head" in wrap)


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "<td>x" * 100_000, "<ul>" + "<i>" * 100_000 + "<li>x" * 100_000, "<a '>x" * 100_000, "<b>" * 100_000 + "<header>x" * 100_000, "<p>x<svg><path>" * 100_000, "<p>x<script>" + "</script " * 100_000])
def test_odd_nesting_is_parsed_in_linear_time(page):
    began = time.time()
    assert html.Page(page).main_text([])
    assert time.time() - began < 15


@pytest.mark.parametrize("drawing", ['<svg width="1"/>', "<svg/>", '<svg viewBox="0 0 1 1"><path d="M0"/><g/></svg>', "<svg width=1/>", "<svg><circle>", "<math/>", '<iframe src="x"/>', "<svg><title>no</title><style>no</style></svg>", "<SVG><text>no</text></SVG>"])
def test_a_drawing_does_not_swallow_the_article(drawing):
    assert text_by_itself(f"<body><div>{drawing}<p>ARTICLE</p></div></body>") == "ARTICLE"


def test_a_notice_is_no_article_however_long():
    for notice, article in ((3, 1), (50, 6), (400, 2)):
        for name in ("cookie-notice", "gdpr consent", "alert", "popup"):
            got = text_by_itself(f"<body><div class='{name}'>{'We use cookies. ' * notice}</div><div class=c><p>{'ARTICLE ' * article}</p></div></body>")
            assert got == ("ARTICLE " * article).strip()
    assert text_by_itself(f"<body><div class='alert-page'><h1>Title</h1><p>{PROSE}</p></div><div>us</div></body>").startswith("Title")


def test_quotes_outside_of_values_end_nothing():
    assert text_by_itself("<body><p title=don't>one</p><p title='x>y'>two</p><p ' >three</p><a href=http://x.org/>four</a></body>") == "one\ntwo\nthree\nfour"


def naive_texts(rows):
    """The consensus in plain Python over whole hosts; every page votes and is read again by itself."""
    votes = defaultdict(Counter)
    host_of = {url: (re.match(r"https?://([^/]*)", url or "") or [None, ""])[1].lower() for _, url, _ in rows}
    for _, url, source in rows:
        for path, share in html.Page(source or "").votes():
            votes[host_of[url]][path] += round(1000 * share)
    best = {h: [p for p, _ in sorted(v.items(), key=lambda x: (-x[1], x[0]))[: html.PATHS]] for h, v in votes.items()}
    return Counter((i, url, html.Page(source or "").main_text(best.get(host_of[url], []))) for i, url, source in rows)


def made_pages():
    """(page_id, url, html, article): 210 pages of eight hosts, each with its own way of nesting; some articles are far shorter than what is around."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    said = lambda n: " ".join(word() for _ in range(n))
    for h in range(8):
        nest = [(rng.choice(["div", "section", "div"]), f"{word()}-{rng.choice(['wrap', 'body', 'text'])}") for _ in range(rng.randrange(1, 5))]
        for n in range(26):
            blocks = [said(rng.randrange(15, 40)) for _ in range(rng.randrange(3, 8))] if n % 9 else [said(3)]
            inner = "".join(f"<p>{b}</p>" if k % 2 else f"<p>{b.replace(' ', ' <i>', 1)}</i></p>" for k, b in enumerate(blocks))
            for tag, name in reversed(nest):
                inner = f'<{tag} class="{name}">{inner}</{tag}>'
            nav = "<nav><ul>" + "".join(f'<li><a href="/{k}">{word()}</a>' for k in range(9)) + "</ul></nav>"
            extra = f'<div class="cookie-notice"><p>{said(60)}</p></div>' if n % 3 == 0 else ""
            page = f'<html><head><title>{word()}</title></head><body>{nav}{extra}{inner}<div class="sidebar"><p>{said(30)}</p></div><footer>{said(12)}</footer></body></html>'
            yield 100 * h + n, f"https://H{h}.example.org/{n}", page, "\n".join(blocks)
    yield 9000, None, None, ""
    yield 9001, "https://h1.example.org/empty", "", ""


def test_consensus_equals_a_naive_one_over_whole_hosts(spark):
    made = list(made_pages())
    rows = [r[:3] for r in made]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = Counter((r["page_id"], r["url"], r["text"]) for r in html.main_texts(df).collect())
    assert got == naive_texts(rows)
    assert got == Counter((i, url, text) for i, url, _, text in made)


def test_the_query_equals_the_naive_consensus_on_its_own_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    got = html.op10_main_text(spark, "/root/testdata/sf0.001").collect()
    assert Counter((r["page_id"], r["url"], r["text"]) for r in got) == naive_texts(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
