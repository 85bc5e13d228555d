"""Checks of artifacts against plain sets, and their plans."""

from pagetide.operators.integrity import missing_artifacts
from pagetide.plans.manifest import artifacts

SF = "/root/testdata/sf0.001"
NAMES = ("page.html", "page.txt", "meta.json")


def test_missing_artifacts_are_those_of_plain_sets(spark):
    t = [("Deaf Smith ", "polling", "u"), ("Deaf Smith", " polling", "u"), ("Polk", "polling", "u"), ("Polk", "results", " "), ("Ely", "polling", "u"), ("Lee", "polling", "u"), (None, "polling", "u")]
    f = [("deaf_smith", "polling", "page.html"), ("deaf_smith", "polling", "page.html"), ("deaf_smith", "polling", None), ("polk", "results", "page.txt"), ("ely", "polling", "notes.txt"), *[("lee", "polling", n) for n in NAMES], (None, "polling", "page.txt")]
    got = missing_artifacts(spark.createDataFrame(t, "county string, page_type string, url string"), spark.createDataFrame(f, "slug string, page_type string, name string"))
    there = {x[:2] for x in f}
    keys = [(c.strip().lower().replace(" ", "_"), p.strip()) for c, p, u in t if c and u.strip()]
    assert sorted(map(tuple, got.collect())) == sorted((*k, n) for k in keys if k in there for n in NAMES if (*k, n) not in f)


def test_no_exploded_side_is_broadcast(spark):
    """Spark takes 15 rows of each customer for one, so at 900,000 customers it sent some ten million rows to the driver."""
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1_000_000
    df = artifacts(spark, SF)
    assert df.count() > 0
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
