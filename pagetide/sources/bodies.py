"""A store of bodies by content, bucketed by their hashes, and the lines that changed between two hashes.

The history holds hashes alone, so hashes decide what changed; only bodies of changed hashes are read, once each, from buckets that
a join by hash takes as they are: what is shuffled of the store is what changed, not the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import line_changes
from .tables import new_blobs

BUCKETS = 64


def add_bodies(bodies: DataFrame, table: str, path: str | None = None, buckets: int = BUCKETS) -> None:
    """Appends those bodies that the table (sha256, body) does not hold yet. Null bodies have no place in it.

    path: where the table's files lie if not in the warehouse. A store keeps the number of buckets that it was made with.
    """
    spark = bodies.sparkSession
    there = spark.catalog.tableExists(table)
    writer = new_blobs(bodies, spark.table(table) if there else None).write.format("parquet").bucketBy(buckets, "sha256").sortBy("sha256")
    (writer.option("path", path) if path else writer).mode("append").saveAsTable(table)


def bodies_of(hashes: DataFrame, spark: SparkSession, table: str) -> DataFrame:
    """(sha256, body) of the hashes in column sha256 of a table, each once; hashes that the store does not know have no row."""
    wanted = hashes.select("sha256").filter("sha256 is not null").distinct()
    return spark.table(table).join(wanted, "sha256", "left_semi").select("sha256", "body")


def changed_bodies(states: DataFrame, spark: SparkSession, table: str) -> DataFrame:
    """(before_sha256, after_sha256, before, after): each pair of different hashes of states once, with its two bodies."""
    pairs = states.select("before_sha256", "after_sha256").filter("before_sha256 <> after_sha256").distinct()
    both = pairs.select(F.explode(F.array("before_sha256", "after_sha256")).alias("sha256"))
    found = bodies_of(both, spark, table)
    old, new = (found.select(F.col("sha256").alias(f"{side}_sha256"), F.col("body").alias(side)) for side in ("before", "after"))
    return pairs.join(old, "before_sha256").join(new, "after_sha256").select("before_sha256", "after_sha256", "before", "after")


def lines_between(states: DataFrame, keys: list[str], spark: SparkSession, table: str) -> DataFrame:
    """keys, line, removed, added of states (keys, before_sha256, after_sha256) whose hashes differ.

    Targets that went through the same change share its diff, which is worked out once. A target that was not there on one side (a null
    hash), or whose body the store lacks, has no lines.
    """
    pair = ["before_sha256", "after_sha256"]
    diffs = line_changes(changed_bodies(states, spark, table), pair)
    return states.select(*keys, *pair).join(diffs, pair).select(*keys, "line", "removed", "added")
