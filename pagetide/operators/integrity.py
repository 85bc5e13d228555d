"""Checks of manifest, seed and artifacts: each gives the rows that break it; none is good."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import verify
from ..functions.values import slug
from ..functions.vocabulary import PAGE_TYPES

KEY = ["county", "page_type"]


def repeated(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n")).filter("n > 1")


def bad_batches(counties: DataFrame, batches: list[str]) -> DataFrame:
    return counties.filter(~F.coalesce(F.col("batch"), F.lit("")).isin(batches))


def batch_overlap(counties: DataFrame) -> DataFrame:
    return counties.groupBy("county").agg(F.countDistinct("batch").alias("batches")).filter("batches > 1")


def without_seat(counties: DataFrame) -> DataFrame:
    return counties.filter(F.trim(F.coalesce("seat", F.lit(""))) == "")


def missing_rows(counties: DataFrame, targets: DataFrame) -> DataFrame:
    """Counties' page types that the manifest lacks."""
    wanted = counties.select("county", F.explode(F.array(*[F.lit(p) for p in PAGE_TYPES])).alias("page_type"))
    return wanted.join(targets.select(*KEY), KEY, "left_anti")


def unknown_rows(counties: DataFrame, targets: DataFrame) -> DataFrame:
    return targets.join(counties.select("county"), "county", "left_anti").unionByName(targets.join(counties.select("county"), "county", "left_semi").filter(~F.col("page_type").isin(PAGE_TYPES)))


def batch_mismatch(counties: DataFrame, targets: DataFrame) -> DataFrame:
    return targets.join(counties.select("county", F.col("batch").alias("seed_batch")), "county").filter("batch <> seed_batch")


def silent_gaps(targets: DataFrame) -> DataFrame:
    return targets.filter((F.trim("url") == "") & ~F.trim(F.coalesce("notes", F.lit(""))).startswith("GAP"))


def bad_values(targets: DataFrame) -> DataFrame:
    """External flags that are no booleans, URLs that are not over http."""
    return targets.filter(~F.lower(F.trim("external")).isin("true", "false") | ((F.trim("url") != "") & ~F.trim("url").rlike("^https?://")))


def missing_artifacts(targets: DataFrame, files: DataFrame, names: tuple[str, ...] = ("page.html", "page.txt", "meta.json")) -> DataFrame:
    """files: slug, page_type, name. Of targets that have any artifact, those that lack one."""
    wanted = targets.filter(F.trim("url") != "").select(slug(F.trim("county")).alias("slug"), F.trim("page_type").alias("page_type"))
    # One row for each target that has any; Spark's estimates don't count what explode makes, so the join is never left to broadcast.
    found = files.groupBy("slug", "page_type").agg(F.collect_set(F.when(F.col("name").isin(*names), F.col("name"))).alias("found"))
    lacking = F.array_except(F.array(*[F.lit(n) for n in names]), "found")
    return wanted.join(found.hint("merge"), ["slug", "page_type"]).select("slug", "page_type", F.explode(lacking).alias("name"))


def artifacts_of_gaps(targets: DataFrame, files: DataFrame) -> DataFrame:
    gaps = targets.filter(F.trim("url") == "").select(slug(F.trim("county")).alias("slug"), F.trim("page_type").alias("page_type"))
    return files.join(gaps, ["slug", "page_type"], "left_semi")


def bad_metadata(snapshots: DataFrame, targets: DataFrame) -> DataFrame:
    """Incomplete records, unknown render modes, URLs that are not the manifest's."""
    need = ["requested_url", "http_status", "external", "fetched_at", "html_sha256", "text_sha256", "byte_size"]
    incomplete = F.lit(False)
    for c in need:
        incomplete = incomplete | F.col(c).isNull()
    t = targets.filter(F.trim("url") != "").select(*KEY, F.trim("url").alias("manifest_url"))
    j = snapshots.join(t, KEY, "left")
    return j.filter(incomplete | ~F.coalesce(F.col("render_mode"), F.lit("")).isin("plain", "headless") | F.coalesce(F.col("manifest_url") != F.col("requested_url"), F.lit(False)))


def stamped_bodies(bodies: DataFrame) -> DataFrame:
    """bodies: keys, body, fetched_at as text. Bodies that hold the time of their capture."""
    return bodies.filter((F.col("fetched_at") != "") & F.contains(F.col("body"), F.col("fetched_at")))


def bad_homepages(counties: DataFrame, batch: str = "1") -> DataFrame:
    """Counties of the first batch whose homepage is no web address."""
    return counties.filter((F.col("batch") == batch) & ~F.coalesce(F.col("homepage"), F.lit("")).startswith("http"))


def unverified_homepages(homepages: DataFrame) -> DataFrame:
    """Captured homepages (county, seat, url, text, title, others) that no longer pass for their county's."""
    v = verify(F.col("county"), F.col("seat"), F.col("url"), F.col("text"), F.col("title"), F.col("others"))
    return homepages.select("county", "url", v.alias("v")).filter("v.confidence = 'reject'").select("county", "url", "v.evidence")
