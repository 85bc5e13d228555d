"""Round trips of files, and the streaming jobs."""

import datetime as dt
from collections import Counter

from pyspark.sql import functions as F

from pagetide.operators import manifest
from pagetide.plans import inputs
from pagetide.sources import log, tables
from pagetide.streaming import changes

SF = "/root/testdata/sf0.001"


def test_manifest_round_trip(spark, tmp_path):
    t = inputs.targets(spark, SF)
    tables.write_manifest(t.withColumn("extra", F.lit(1)), f"{tmp_path}/m")
    back = tables.read_manifest(spark, f"{tmp_path}/m")
    assert back.columns == t.columns
    assert back.exceptAll(t).isEmpty() and t.exceptAll(back).isEmpty()


def test_absent_columns_are_empty(spark, tmp_path):
    (tmp_path / "s.csv").write_text("county,seat\n Polk , Livingston\n")
    assert tables.read_seed(spark, f"{tmp_path}/s.csv").collect()[0].asDict() == {"county": "Polk", "seat": "Livingston", "batch": "", "homepage": ""}


def test_history_latest_blobs_checkpoint(spark, tmp_path):
    h = inputs.history(spark, SF)
    tables.append_history(h, f"{tmp_path}/h", 7)
    tables.append_history(h, f"{tmp_path}/h", 7)
    assert spark.read.parquet(f"{tmp_path}/h").count() == h.count()
    first = h.filter("capture_id < 100").dropDuplicates(inputs.KEYS)
    new = h.filter("capture_id >= 900").dropDuplicates(inputs.KEYS)
    latest = tables.merged_latest(first, new)
    assert latest.groupBy(*inputs.KEYS).count().filter("count > 1").isEmpty()
    assert latest.join(new.select("capture_id"), "capture_id", "left_semi").count() == new.count()
    bodies = h.select(F.col("html_sha256").alias("body"))
    tables.append_blobs(bodies, None, f"{tmp_path}/b")
    assert tables.new_blobs(bodies, spark.read.parquet(f"{tmp_path}/b")).isEmpty()
    assert tables.read_checkpoint(spark, f"{tmp_path}/c").isEmpty()
    t = inputs.targets(spark, SF)
    tables.write_checkpoint(t.filter("batch = '1'"), f"{tmp_path}/c")
    assert manifest.remaining(t, tables.read_checkpoint(spark, f"{tmp_path}/c")).filter("batch = '1'").isEmpty()
    (tmp_path / "c" / "part-damaged.parquet").write_text("no table")
    assert tables.read_checkpoint(spark, f"{tmp_path}/c").count() == t.filter("batch = '1'").count()
    tables.clear_checkpoint(spark, f"{tmp_path}/c")
    assert tables.read_checkpoint(spark, f"{tmp_path}/c").isEmpty()


def test_latest_versions_replace_their_targets(spark, tmp_path):
    h = inputs.history(spark, SF)
    parts = [h.filter(f"capture_id % 3 = {k}").dropDuplicates(inputs.KEYS) for k in range(3)]
    for k in (0, 1, 2, 2):  # the last run comes again
        tables.replace_latest(parts[k], f"{tmp_path}/l", k)
    assert tables.versions(spark, f"{tmp_path}/l") == [1, 2]
    got = tables.read_latest(spark, f"{tmp_path}/l")
    expected = parts[0]
    for p in parts[1:]:
        expected = tables.merged_latest(expected, p)
    assert got.count() == expected.count() and got.join(parts[2], [*inputs.KEYS, "capture_id"], "left_semi").count() == parts[2].count()
    assert tables.read_latest(spark, f"{tmp_path}/none") is None


def test_reports(spark, tmp_path):
    tried = spark.createDataFrame([("Polk", 2, "u2", "likely", "e"), ("Polk", 1, "u1", "reject", "x|y"), ("Smith", 1, "u", "confident", "")], "county string, priority int, url string, confidence string, evidence string")
    log = {r["county"]: [a["url"] for a in r["attempts"]] for r in tables.probe_log(tried).collect()}
    assert log == {"Polk": ["u1", "u2"], "Smith": ["u"]}
    tables.write_json(tables.probe_log(tried), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").filter("size(attempts) = 2").count() == 1
    tables.write_table_as_markdown(tried.select("county", "evidence").filter("priority = 1"), f"{tmp_path}/m")
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/m").collect()]
    assert lines[:2] == ["| county | evidence |", "|---|---|"] and "| Polk | x\\|y |" in lines
    t = inputs.targets(spark, SF)
    seed = t.select("county").distinct().select("county", F.col("county").substr(-9, 9).cast("int").alias("position"))
    draft = manifest.in_seed_order(t.orderBy(F.rand(1)), seed)
    tables.write_draft(draft, f"{tmp_path}/d")
    back = [(r["county"], r["page_type"]) for r in tables.read_draft(spark, f"{tmp_path}/d").collect()]
    order = {p: k for k, p in enumerate(inputs.PAGE_TYPES)}
    assert back == sorted(back, key=lambda r: (int(r[0][-9:]), order[r[1]]))
    found = spark.createDataFrame([("Polk", "L", "https://p", "likely", "e"), ("Smith", "T", "", "confident", "e")], "county string, seat string, homepage string, confidence string, evidence string")
    tables.write_homepages(found, f"{tmp_path}/h")
    assert [(r["county"], r["flag_for_review"]) for r in tables.read_homepages(spark, f"{tmp_path}/h").collect()] == [("Polk", "yes")]
    table = tables.read_captures(spark, f"{SF}/pages.parquet")
    assert table.filter("ok and http_status = 200 and html is not null").count() == table.count() > 0


def test_streamed_captures_are_cleaned_once_into_history_and_latest(spark, tmp_path):
    rows = [("Polk", "results", f"<p>{k}</p><script>{k}</script>", "text/html", None, dt.datetime(2026, 7, 1 + k)) for k in range(3)] + [("Smith", "results", None, "text/html", "timeout", dt.datetime(2026, 7, 1))]
    schema = "county string, page_type string, html string, content_type string, error string, fetched_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    job = changes.capture_job(f"{tmp_path}/archive")

    def twice(batch, number):
        job(batch, number)
        job(batch, number)

    changes.ingest(changes.read_captures(spark, f"{tmp_path}/in", schema), f"{tmp_path}/cp", twice).awaitTermination(120)
    assert log.read_history(spark, f"{tmp_path}/archive").count() == 4
    latest = {r["county"]: r for r in log.read_state(spark, f"{tmp_path}/archive").collect()}
    assert set(latest) == {"Polk", "Smith"} and latest["Polk"]["page_txt"] == "2\n" and latest["Smith"]["error"] == "timeout"


def test_bodies_and_metadata(spark, tmp_path):
    d = tmp_path / "polk" / "elections"
    d.mkdir(parents=True)
    (d / "page.txt").write_text("a\nb\n")
    (d / "page.html").write_text("<p>a</p>")
    (d / "meta.json").write_text('{"county": "Polk",\n "page_type": "elections", "http_status": 200, "fetched_at": "2026-08-08T08:25:34Z"}')
    assert {(r["name"], r["body"]) for r in tables.read_bodies(spark, str(tmp_path)).collect()} == {("page.txt", "a\nb\n"), ("page.html", "<p>a</p>")}
    m = tables.read_snapshots(spark, str(tmp_path)).collect()[0]
    assert (m["slug"], m["folder_type"], m["http_status"], m["fetched_at"]) == ("polk", "elections", 200, dt.datetime(2026, 8, 8, 8, 25, 34))
    assert '"title":null' in tables.snapshot_record(tables.read_snapshots(spark, str(tmp_path))).select("meta").collect()[0]["meta"]


def test_streamed_changes_equal_those_of_the_table(spark, tmp_path):
    from pagetide.operators.history import changes as of_table

    h = inputs.history(spark, SF).select("county", "page_type", "fetched_at", "html_sha256", "text_sha256", "capture_id")
    h.filter("capture_id < 500").coalesce(1).write.parquet(f"{tmp_path}/in")
    h.filter("capture_id >= 500").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = changes.read_captures(spark, f"{tmp_path}/in", h.schema).select("county", "page_type", "fetched_at", "html_sha256", "text_sha256")
    q = changes.changes(stream, inputs.KEYS).writeStream.format("memory").queryName("changed").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    expected = of_table(h, inputs.KEYS)
    assert spark.table("changed").count() == expected.count() > 0


def test_state_of_silent_targets_ends(spark, tmp_path):
    """Rows of the stream are those of the table: gaps, changes within them, and no state is left of targets that are silent."""
    from pagetide.operators.history import changes as of_table
    from pagetide.operators.history import gaps

    columns = ["county", "page_type", "fetched_at", "html_sha256", "text_sha256"]
    h = inputs.history(spark, SF)
    h = h.filter("page_type <> 'elections' or day(fetched_at) < 10")
    silence, lateness = "3 days", "1 day"
    cuts = [F.col("fetched_at") < F.lit("2024-01-12").cast("timestamp"), F.col("fetched_at") >= F.lit("2024-01-12").cast("timestamp")]
    for n, part in enumerate(cuts):
        h.filter(part).select(columns).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = changes.followed(changes.read_captures(spark, f"{tmp_path}/in", h.select(columns).schema), inputs.KEYS, silence, lateness)
        q = stream.writeStream.foreachBatch(lambda df, k, n=n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/run={n}/batch={k}")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").select(*inputs.KEYS, "fetched_at", "status")
    newest = h.agg(F.max("fetched_at")).collect()[0][0]
    silent = gaps(h, inputs.KEYS, silence, F.lit(newest - dt.timedelta(days=1)))
    assert Counter(map(tuple, got.filter("status = 'stale'").select(*inputs.KEYS, "fetched_at").collect())) == Counter(map(tuple, silent.select(*inputs.KEYS, "stale_at").collect()))
    within = of_table(h, inputs.KEYS).filter(F.col("fetched_at") <= F.col("prev_at") + F.expr(f"interval {silence}")).select(*inputs.KEYS, "fetched_at")
    assert Counter(map(tuple, got.filter("status = 'changed'").select(*inputs.KEYS, "fetched_at").collect())) == Counter(map(tuple, within.collect()))
    held = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    targets, last = h.select(*inputs.KEYS).distinct().count(), silent.groupBy(*inputs.KEYS).agg(F.max("last_at").alias("m"))
    ended = last.join(h.groupBy(*inputs.KEYS).agg(F.max("fetched_at").alias("m")), [*inputs.KEYS, "m"]).count()
    assert silent.count() > 0 and within.count() > 0 and ended > 0 and held == targets - ended


def test_streamed_ingestion_and_windows(spark, tmp_path):
    h = inputs.history(spark, SF).select("county", "page_type", "fetched_at")
    h.write.parquet(f"{tmp_path}/in")
    stream = changes.deduplicated(changes.read_captures(spark, f"{tmp_path}/in", h.schema), inputs.KEYS)
    changes.ingest(stream, f"{tmp_path}/cp", lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == h.dropDuplicates([*inputs.KEYS, "fetched_at"]).count()
    assert changes.per_window(h).agg(F.sum("n_changes")).collect()[0][0] == h.count()
