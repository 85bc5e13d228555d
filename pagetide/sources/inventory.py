"""What lies in a folder of snapshots, told by names and sizes alone: no file is read for it."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import slug

NOTHING = hashlib.sha256(b"").hexdigest()
ARTIFACTS = ("page.html", "page.txt", "meta.json")


def list_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """slug, page_type, name, length, modified of each file <root>/<slug>/<page type>/<name>; files at other depths are no artifacts.

    Only paths, lengths and times are asked of the scan, so contents stay unread. Spark's scans leave out files without a byte.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    base = F.lit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/")
    inside = F.element_at(F.split("path", base, 2), -1)
    parts = F.split(inside, "/")
    return files.withColumn("_p", parts).filter(F.size("_p") == 3).select(
        F.get("_p", 0).alias("slug"), F.get("_p", 1).alias("page_type"), F.get("_p", 2).alias("name"), "length", F.col("modificationTime").alias("modified"),
    )


def artifact_problems(targets: DataFrame, artifacts: DataFrame, metadata: DataFrame) -> DataFrame:
    """slug, page_type, name, problem, sorted out by one aggregate for each target's folder.

    metadata: slug, page_type, byte_size, text_sha256. `missing`: of a captured target's three artifacts one is not there or has no byte, while
    others are, and its record does not say that it is empty; `size`: page.html is not as long as its record says; `gap`: artifacts of a
    target without a URL; `unknown`: artifacts of no target. A target whose folder is not there has not been captured yet, which is no problem.
    """
    wanted = targets.select(slug(F.trim("county")).alias("slug"), F.trim("page_type").alias("page_type"), (F.trim("url") != "").alias("captured"))
    wanted = wanted.groupBy("slug", "page_type").agg(F.bool_or("captured").alias("captured"))
    folders = artifacts.groupBy("slug", "page_type").agg(F.collect_set("name").alias("names"))
    expected = F.array(*[F.lit(n) for n in ARTIFACTS])
    by_folder = folders.join(wanted, ["slug", "page_type"], "left")
    missing = by_folder.filter("captured").select("slug", "page_type", F.explode(F.array_except(expected, "names")).alias("name"), F.lit("missing").alias("problem"))
    strange = by_folder.filter("captured is null or not captured").select("slug", "page_type", F.explode("names").alias("name"), F.when(F.col("captured").isNull(), "unknown").otherwise("gap").alias("problem"))
    none = metadata.select("slug", "page_type", F.explode(F.array_compact(F.array(F.when(F.col("byte_size") == 0, "page.html"), F.when(F.col("text_sha256") == NOTHING, "page.txt")))).alias("name"))
    missing = missing.join(none, ["slug", "page_type", "name"], "left_anti")
    told = metadata.select("slug", "page_type", F.col("byte_size").cast("long").alias("byte_size"))
    size = artifacts.filter("name = 'page.html'").join(told, ["slug", "page_type"]).filter("length <> byte_size").select("slug", "page_type", "name", F.lit("size").alias("problem"))
    return missing.unionByName(strange).unionByName(size)
