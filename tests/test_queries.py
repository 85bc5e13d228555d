"""Every registered query of the core against its SQL in DuckDB, at the smallest scale."""

import duckdb
import pytest

from pagetide.plans import crawl, evidence, history, manifest, pages, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else None if v is None else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=lambda r: tuple((x is not None, x or "") for x in r))


@pytest.mark.parametrize("name", list(registry.SQL))
def test_query_matches_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cur = duck.execute(registry.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


CUT = """<!DOCTYPE html><html lang="en"><head><title>{0}</title><script>var t="</p>&amp";track(1);</script></head><body><nav><ul><li><a href="/T&amp;{0}">To {0}</a></li></ul></nav><!-- ad -->
<article><h1>{0}</h1><p>R&D &copy; 2026 &middot; &quot;x&quot; &amp;lt; {0}</p></article></body></html>"""


def cut_pages(spark, duck_dir):
    """Pages whose texts were cut inside a character reference, as some of the larger tables' are."""
    rows = [(k, f"https://h{k}.org/a", CUT.format(x)) for k, x in enumerate(["a &amp", "a &am", "b&amp;&amp", "&quot", "c &copy", "&lt", "&gt;&gt", "&#39", "&ampx;", "d & e", "&ampersand", "f&"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{duck_dir}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{duck_dir}/pages.parquet/*.parquet')")
    return con


def held_against_sql(spark, con, folder, name):
    df, cur = registry.QUERIES[name](spark, str(folder)), con.execute(registry.SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_titles_cut_inside_a_reference(spark, tmp_path):
    held_against_sql(spark, cut_pages(spark, tmp_path), tmp_path, "page_titles")


def test_visible_texts_cut_inside_a_reference(spark, tmp_path):
    held_against_sql(spark, cut_pages(spark, tmp_path), tmp_path, "visible_texts")
