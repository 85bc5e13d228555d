"""The archive of captures as one log of runs: history, latest state and ledger.

A run writes its captures as parts by bucket of the target, `log/run_id=N/bucket=B`, and then one record in the ledger,
`runs/run_id=N`, with its counts. Readers see only runs that the ledger names, so a run that dies between the two is not
there, and one that comes again replaces its own parts and its own record. What a run writes is as large as the run, not as
the archive.

The state of a target is its last capture by time of capture, whatever the order of runs: one that comes late goes into the history
and does not replace a newer one. Equal times are settled by the run, then by the content. A deletion is a capture with
`deleted` (a tombstone). compact() writes the state of some buckets as it is after a run, `base/upto=N/bucket=B`; readers
then start from each bucket's newest base and merge the runs behind it. A tombstone stays in the base, as captures that
are older than it may still come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

TARGET = ["county", "page_type"]
BUCKETS = 64  # of an archive, for good; a state is read and compacted bucket by bucket


def bucket_of(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _there(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders of a path whose write was finished."""
    child = spark._jvm.org.apache.hadoop.fs.Path
    at = child(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    return sorted(x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory() and fs.exists(child(x.getPath(), "_SUCCESS")))


def committed(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the runs that the ledger names."""
    return sorted(int(n.removeprefix("run_id=")) for n in _there(spark, f"{root}/runs"))


def read_ledger(spark: SparkSession, root: str) -> DataFrame | None:
    """One record for each run; None before the first."""
    runs = committed(spark, root)
    return spark.read.option("basePath", f"{root}/runs").parquet(*[f"{root}/runs/run_id={n}" for n in runs]) if runs else None


def read_history(spark: SparkSession, root: str, after: int | None = None) -> DataFrame | None:
    """All captures of runs that the ledger names (after one), with run_id and bucket; None if there are none."""
    ledger = read_ledger(spark, root)
    runs = sorted(r["run_id"] for r in ledger.filter("n_captures > 0").select("run_id").collect()) if ledger is not None else []
    paths = [f"{root}/log/run_id={n}" for n in runs if after is None or n > after]
    return spark.read.option("basePath", f"{root}/log").option("mergeSchema", True).parquet(*paths) if paths else None


def newest(captures: DataFrame, keys: list[str] = TARGET) -> DataFrame:
    """The last capture of each target, tombstones included: by time, then run, then content."""
    rest = [c for c in captures.columns if c not in keys]
    order = F.struct("fetched_at", "run_id", F.xxhash64(*rest))
    return captures.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("s")).select(*keys, "s.*")


def _bases(spark: SparkSession, root: str) -> dict[int, int]:
    """bucket -> the run up to which its newest base goes."""
    found: dict[int, int] = {}
    for folder in _there(spark, f"{root}/base"):
        upto, buckets = folder.removeprefix("upto=").split("-")
        for b in range(*(int(x) for x in buckets.split("_"))):
            found[b] = max(found.get(b, -1), int(upto))
    return found


def read_state(spark: SparkSession, root: str, deleted: bool = False) -> DataFrame | None:
    """The last capture of each target: bases, and runs behind them, merged on reading. None before the first capture."""
    bases, runs = _bases(spark, root), committed(spark, root)
    if not runs:
        return None
    parts = []
    for folder in _there(spark, f"{root}/base"):
        upto, buckets = folder.removeprefix("upto=").split("-")
        own = [b for b in range(*(int(x) for x in buckets.split("_"))) if bases[b] == int(upto)]
        if own:
            parts.append(spark.read.parquet(f"{root}/base/{folder}").filter(F.col("bucket").isin(own)))
    for upto in sorted({bases.get(b, -1) for b in range(BUCKETS)}):
        own = [b for b in range(BUCKETS) if bases.get(b, -1) == upto]
        log = read_history(spark, root, None if upto < 0 else upto)
        if log is not None:
            parts.append(log.filter(F.col("bucket").isin(own)))  # a filter on folders
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    state = newest(out)
    return state if deleted else state.filter(~F.col("deleted"))


def compact(spark: SparkSession, root: str, first: int = 0, end: int = BUCKETS) -> None:
    """Writes the state of buckets first to end (exclusive) after the last run; the log itself stays, as it is the history."""
    state, runs = read_state(spark, root, deleted=True), committed(spark, root)
    if state is not None:
        own = state.filter(F.col("bucket").between(first, end - 1))
        own.repartition("bucket").sortWithinPartitions(*TARGET).write.partitionBy("bucket").mode("overwrite").parquet(f"{root}/base/upto={runs[-1]}-{first}_{end}")


def tombstones(state: DataFrame, manifest: DataFrame, at: Column) -> DataFrame:
    """Deletions, at a time, of targets that are in the state and no longer in the manifest (county, page_type, url): county,
    page_type, fetched_at, deleted. A gap (a row without a URL) is in the manifest but has no page, so it goes as well."""
    claimed = manifest.filter(F.trim("url") != "").select(*TARGET).distinct()
    return state.join(claimed, TARGET, "left_anti").select(*TARGET, at.alias("fetched_at"), F.lit(True).alias("deleted"))


def write_parts(captures: DataFrame, root: str, run: int) -> DataFrame:
    """The first half of a run: its captures, in parts by bucket. Not to be seen until commit()."""
    own = captures if "deleted" in captures.columns else captures.withColumn("deleted", F.lit(False))
    own = own.withColumn("deleted", F.coalesce("deleted", F.lit(False))).dropDuplicates().withColumn("bucket", bucket_of(*TARGET))
    path = f"{root}/log/run_id={run}"
    own.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)
    schema = StructType([f for f in own.schema if f.name != "bucket"]).add("bucket", IntegerType())
    return captures.sparkSession.read.schema(schema).parquet(path).withColumn("run_id", F.lit(run))


def commit(own: DataFrame, root: str, run: int) -> None:
    """The second half: the run's record. Counts are against the state of the earlier runs: captures, targets, deletions, errors, those
    of new targets, changed ones (content other than that of the state), and late ones (older than the state)."""
    spark = own.sparkSession
    hashes = [c for c in ("html_sha256", "text_sha256") if c in own.columns]
    log = read_history(spark, root)
    last = newest(own)
    if log is None:
        joined = last.select("*", *[F.lit(None).alias(f"old_{c}") for c in ("fetched_at", *hashes)], F.lit(True).alias("old_deleted"))
    else:
        # only targets of this run, so what is read is cut to them before it is summed
        before = newest(log.filter(F.col("run_id") < run).join(last.select(*TARGET), TARGET, "left_semi"))
        old = before.select(*TARGET, *[F.col(c).alias(f"old_{c}") for c in ("fetched_at", "deleted", *hashes)])
        joined = last.join(old, TARGET, "left")
    was = ~F.coalesce("old_deleted", F.lit(True))
    late = F.coalesce(F.col("fetched_at") < F.col("old_fetched_at"), F.lit(False))
    other = F.lit(False)
    for c in hashes:
        other = other | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    live = ~F.col("deleted") & ~late
    error = F.col("error").isNotNull() if "error" in own.columns else F.lit(False)
    counts = joined.agg(
        F.count("*").alias("n_targets"), F.count_if(F.col("deleted") & was & ~late).alias("n_deleted"), F.count_if(live & ~was).alias("n_new"),
        F.count_if(live & was & other).alias("n_changed"), F.count_if(late).alias("n_late"), F.count_if(error).alias("n_errors"),
    )
    record = counts.withColumn("n_captures", F.lit(own.count())).withColumn("zero_diff", F.expr("n_deleted + n_new + n_changed = 0"))
    record.coalesce(1).write.mode("overwrite").parquet(f"{root}/runs/run_id={run}")


def append_run(captures: DataFrame, root: str, run: int) -> None:
    """A whole run: (county, page_type, fetched_at, ...; deleted, html_sha256, text_sha256, error if there are any). A run
    without rows gets a record as well. Rows that are equal in all columns count once."""
    commit(write_parts(captures, root, run), root, run)
