"""Readers and writers of the seed, the manifest, captures, snapshots, bodies, history and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.values import target_key
from ..functions.vocabulary import AUDIT_COLUMNS, BASE_COLUMNS


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; absent columns and values are empty strings. Columns go by name, in any order."""
    header = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', nullValue="\0")
    names = [x.split()[0] for x in schema.split(", ")]
    return header.select(*[F.coalesce(F.col(n), F.lit("")).alias(n) if n in header.columns else F.lit("").alias(n) for n in names])


def read_seed(spark: SparkSession, path: str, batch: str | None = None) -> DataFrame:
    seed = _csv(spark, path, schemas.COUNTIES)
    seed = seed.select(*[F.trim(c).alias(c) for c in seed.columns])
    return seed if batch is None else seed.filter(F.col("batch") == str(batch))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.TARGETS)


def read_homepages(spark: SparkSession, path: str) -> DataFrame:
    """Homepages that were found; counties without one have no row."""
    return _csv(spark, path, schemas.HOMEPAGES).filter(F.trim("homepage") != "")


def read_draft(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.DRAFT)


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Metadata beside each page, with the folder's names: <root>/<slug>/<page type>/meta.json."""
    df = spark.read.schema(schemas.SNAPSHOTS).json(f"{root}/*/*/meta.json", multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    at = r"/([^/]+)/([^/]+)/meta\.json$"
    return df.withColumn("slug", F.regexp_extract("file", at, 1)).withColumn("folder_type", F.regexp_extract("file", at, 2)).drop("file")


def read_bodies(spark: SparkSession, root: str) -> DataFrame:
    """slug, page_type, name, body: whole files, one row each."""
    df = spark.read.text(f"{root}/*/*/page.*", wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    at = r"/([^/]+)/([^/]+)/(page\.\w+)$"
    return df.select(*[F.regexp_extract("file", at, k).alias(n) for k, n in ((1, "slug"), (2, "page_type"), (3, "name"))], F.col("value").alias("body"))


def read_captures(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Fetch results; or a plain crawl of (url, html), whose pages count as fetched once, well."""
    df = spark.read.format(kind).load(path) if kind == "parquet" else spark.read.schema(schemas.CAPTURES).format(kind).load(path)
    return crawl_as_captures(df) if "requested_url" not in df.columns else df


def crawl_as_captures(pages: DataFrame, run: str = "1970-01-01 00:00:00") -> DataFrame:
    at = F.to_timestamp(F.lit(run))
    return pages.select(
        F.col("url").alias("requested_url"), at.alias("run"), F.lit("plain").alias("path"), F.lit(True).alias("http2"), F.lit(1).alias("attempt"), F.lit(True).alias("ok"),
        "html", F.col("url").alias("final_url"), F.array("url").alias("redirect_chain"), F.lit(200).alias("http_status"), F.lit("text/html").alias("content_type"), F.lit(None).cast("string").alias("error"), at.alias("fetched_at"),
    )


def merged_latest(latest: DataFrame, new: DataFrame) -> DataFrame:
    """New rows in place of the same targets' old ones; other targets stay."""
    return latest.join(new.select("county", "page_type").distinct(), ["county", "page_type"], "left_anti").unionByName(new)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Whole versions of a table of latest captures, in order."""
    fs, at = _files(spark, path)
    found = [x.getPath() for x in fs.listStatus(at)] if fs.exists(at) else []
    child = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(f.getName()[8:]) for f in found if f.getName().startswith("version=") and fs.exists(child(f, "_SUCCESS")))


def read_latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The last whole version (before a number); None if there is none."""
    there = [v for v in versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/version={there[-1]}") if there else None


def replace_latest(new: DataFrame, path: str, run: int) -> None:
    """New captures in place of their targets' old ones, as version `run`: a version takes effect when it is whole, and a
    run that comes again writes the same. The one before stays for readers that have begun; older ones go."""
    spark = new.sparkSession
    latest = read_latest(spark, path, before=run)
    merged = new if latest is None else merged_latest(latest, new)
    merged.write.partitionBy("page_type").mode("overwrite").parquet(f"{path}/version={run}")
    for v in versions(spark, path)[:-2]:
        fs, at = _files(spark, f"{path}/version={v}")
        fs.delete(at, True)


def append_history(new: DataFrame, path: str, run: int) -> None:
    """One partition for each day and run: a run only adds files, and replaces its own if it comes again."""
    days = new.withColumn("run_date", F.to_date("fetched_at")).withColumn("run_id", F.lit(run))
    days.write.partitionBy("run_date", "run_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def new_blobs(bodies: DataFrame, stored: DataFrame | None) -> DataFrame:
    """(sha256, body) of bodies that the store does not hold yet, each once."""
    own = bodies.filter(F.col("body").isNotNull()).select(F.sha2(F.col("body").cast("binary"), 256).alias("sha256"), "body").groupBy("sha256").agg(F.first("body").alias("body"))
    return own if stored is None else own.join(stored.select("sha256"), "sha256", "left_anti")


def append_blobs(bodies: DataFrame, stored: DataFrame | None, path: str) -> None:
    new_blobs(bodies, stored).write.mode("append").parquet(path)


def write_checkpoint(done: DataFrame, path: str) -> None:
    done.select(target_key(F.col("county"), F.col("page_type")).alias("target_key")).distinct().write.mode("append").parquet(path)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Keys that are done; none if there is no checkpoint. Damaged files are passed over: what they held is done again."""
    try:
        return spark.read.schema(schemas.CHECKPOINT).option("ignoreCorruptFiles", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schemas.CHECKPOINT)
        raise


def clear_checkpoint(spark: SparkSession, path: str) -> None:
    """After a run that came to its end."""
    fs, at = _files(spark, path)
    fs.delete(at, True)


def write_manifest(targets: DataFrame, path: str) -> None:
    """Columns in their order; others are left out."""
    targets.select(*BASE_COLUMNS, *AUDIT_COLUMNS).write.mode("overwrite").csv(path, header=True, emptyValue="", escape='"')


def markdown_cell(c):
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", r"\\|"), r"[\r\n]", " ")


def write_table_as_markdown(df: DataFrame, path: str) -> None:
    """A report's table as lines of Markdown. Reports have a few rows, whatever the size of the archive."""
    head = "| " + " | ".join(df.columns) + " |"
    rule = "|" + "---|" * len(df.columns)
    body = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(c).cast("string")) for c in df.columns]), F.lit(" |")).alias("value"))
    top = df.sparkSession.createDataFrame([(head,), (rule,)], "value string")
    top.coalesce(1).union(body).coalesce(1).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """Nested logs and reports: probes with their attempts, pages with their suggestions."""
    df.write.mode("overwrite").json(path)


def probe_log(tried: DataFrame) -> DataFrame:
    """county, attempts: what was tried for each county (priority, url, confidence, evidence), in order. Candidates are at most sixteen."""
    return tried.groupBy("county").agg(F.sort_array(F.collect_list(F.struct("priority", "url", "confidence", "evidence"))).alias("attempts"))


def write_draft(draft: DataFrame, path: str) -> None:
    """A draft of the manifest, in the order it has."""
    draft.select(*BASE_COLUMNS).coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="", escape='"')


def write_homepages(found: DataFrame, path: str) -> None:
    found.withColumn("flag_for_review", F.when(F.col("confidence") == "confident", "").otherwise("yes")).select("county", "seat", "homepage", "confidence", "evidence", "flag_for_review").write.mode("overwrite").csv(path, header=True, emptyValue="")


def snapshot_record(df: DataFrame) -> DataFrame:
    """meta: the record of a page as JSON, all fields, characters as they are."""
    fields = [x.split()[0] for x in schemas.SNAPSHOTS.split(", ")]
    return df.withColumn("meta", F.to_json(F.struct(*fields), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"}))
