"""The archive: late, equal and repeated captures, deletions, runs that die, compaction, the ledger."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from pagetide.operators import history as H
from pagetide.sources import log

SCHEMA = "county string, page_type string, fetched_at timestamp, html_sha256 string, text_sha256 string, error string, deleted boolean"


def day(n):
    return dt.datetime(2026, 1, n)


def run_of(spark, *rows):
    return spark.createDataFrame([(c, "results", day(n), h, h, None, h is None) for c, n, h in rows], SCHEMA)


def state(spark, root):
    s = log.read_state(spark, root)
    return {} if s is None else {r["county"]: (r["fetched_at"].day, r["html_sha256"]) for r in s.collect()}


def ledger(spark, root):
    return {r["run_id"]: r.asDict() for r in log.read_ledger(spark, root).collect()}


def test_late_captures_do_not_replace_newer_ones(spark, tmp_path):
    root = f"{tmp_path}/a"
    assert log.read_state(spark, root) is None and log.read_history(spark, root) is None and log.read_ledger(spark, root) is None
    log.append_run(run_of(spark, ("Polk", 9, "x"), ("Smith", 3, "y")), root, 1)
    log.append_run(run_of(spark, ("Polk", 2, "old"), ("Smith", 4, "y")), root, 2)
    assert state(spark, root) == {"Polk": (9, "x"), "Smith": (4, "y")}
    assert log.read_history(spark, root).count() == 4
    two = ledger(spark, root)[2]
    assert (two["n_targets"], two["n_late"], two["n_changed"], two["zero_diff"]) == (2, 1, 0, True)


def test_equal_and_repeated_captures(spark, tmp_path):
    root = f"{tmp_path}/a"
    log.append_run(run_of(spark, ("Polk", 9, "x"), ("Polk", 9, "x")), root, 1)
    log.append_run(run_of(spark, ("Polk", 9, "z")), root, 2)
    assert log.read_history(spark, root).count() == 2 and state(spark, root) == {"Polk": (9, "z")}  # the later run settles it
    before = ledger(spark, root)
    log.append_run(run_of(spark, ("Polk", 9, "z")), root, 2)
    assert ledger(spark, root) == before and log.read_history(spark, root).count() == 2


def test_a_run_that_dies_is_not_there(spark, tmp_path):
    root = f"{tmp_path}/a"
    log.append_run(run_of(spark, ("Polk", 1, "x")), root, 1)
    log.write_parts(run_of(spark, ("Polk", 2, "y"), ("Smith", 2, "s")), root, 2)  # and no record
    assert state(spark, root) == {"Polk": (1, "x")} and log.committed(spark, root) == [1]
    log.append_run(run_of(spark, ("Ellis", 3, "e")), root, 3)
    assert set(state(spark, root)) == {"Polk", "Ellis"}
    log.append_run(run_of(spark, ("Polk", 2, "y"), ("Smith", 2, "s")), root, 2)
    assert state(spark, root) == {"Polk": (2, "y"), "Smith": (2, "s"), "Ellis": (3, "e")}
    assert [(n, r["n_new"], r["n_changed"]) for n, r in sorted(ledger(spark, root).items())] == [(1, 1, 0), (2, 1, 1), (3, 1, 0)]


def test_deletions_and_captures_after_them(spark, tmp_path):
    root = f"{tmp_path}/a"
    log.append_run(run_of(spark, ("Polk", 1, "x"), ("Smith", 1, "s"), ("Gap", 1, "g")), root, 1)
    manifest = spark.createDataFrame([("Smith", "results", "https://s"), ("Gap", "results", " ")], "county string, page_type string, url string")
    stale = log.tombstones(log.read_state(spark, root), manifest, F.lit(day(2)))
    log.append_run(stale, root, 2)
    assert state(spark, root) == {"Smith": (1, "s")} and ledger(spark, root)[2]["n_deleted"] == 2
    log.append_run(run_of(spark, ("Polk", 1, "late")), root, 3)  # older than its deletion
    assert set(state(spark, root)) == {"Smith"}
    log.append_run(run_of(spark, ("Polk", 3, "x")), root, 4)
    assert state(spark, root)["Polk"] == (3, "x") and ledger(spark, root)[4]["n_new"] == 1
    h = log.read_history(spark, root).withColumn("capture_id", F.col("run_id"))
    got = [(r["fetched_at"].day, r["status"]) for r in H.page_log(h.filter("county = 'Polk'"), log.TARGET).orderBy("fetched_at", "status").collect()]
    assert got == [(1, "A"), (1, "M"), (2, "D"), (3, "A")]
    status = lambda a, b: {r["county"]: r["status"] for r in H.diff(h, log.TARGET, F.lit(day(a)), F.lit(day(b))).collect()}
    assert status(1, 2) == {"Polk": "D", "Gap": "D"} and status(2, 3) == {"Polk": "A"} and status(1, 3) == {"Gap": "D", "Polk": "M"}


def test_any_order_of_runs_and_compactions_gives_one_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "BUCKETS", 4)
    rng = random.Random(3)
    captures = [(f"c{rng.randrange(8)}", rng.randrange(1, 28), rng.choice(["x", "y", "z", None])) for _ in range(60)]
    captures = list({(c, n): (c, n, h) for c, n, h in captures}.values())
    want: dict = {}
    for c, n, h in sorted(captures, key=lambda r: r[1]):
        want[c] = (n, h)
    want = {c: v for c, v in want.items() if v[1] is not None}
    rng.shuffle(captures)
    root, cut = f"{tmp_path}/a", len(captures) // 3 + 1
    for k in range(3):
        log.append_run(run_of(spark, *captures[k * cut : (k + 1) * cut]), root, k)
        if k == 0:
            log.compact(spark, root)
        if k == 1:
            log.compact(spark, root, 1, 3)  # half of the buckets
    assert state(spark, root) == want
    log.compact(spark, root)
    assert state(spark, root) == want
    log.append_run(run_of(spark, ("late", 1, "l")).limit(0), root, 9)
    assert state(spark, root) == want and ledger(spark, root)[9]["n_captures"] == 0


def test_a_run_writes_as_much_as_it_has(spark, tmp_path):
    root = f"{tmp_path}/a"
    log.append_run(run_of(spark, *[(f"county {k}", 1, f"{k:064d}") for k in range(3000)]), root, 1)
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs)
    before = size()
    log.append_run(run_of(spark, ("county 5", 2, "new")), root, 2)
    assert size() - before < before / 8
    plan = log.read_history(spark, root).filter("bucket = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:80]
