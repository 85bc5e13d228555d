"""The library's tables, derived from the driver's: the same columns in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import AUDIT_COLUMNS, BASE_COLUMNS, PAGE_TYPES

KEYS = ["county", "page_type"]
TYPES_SQL = "[" + ", ".join(f"'{p}'" for p in PAGE_TYPES) + "]"
ROWS_SQL = ", ".join(f"({k}, '{p}')" for k, p in enumerate(PAGE_TYPES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer pieces than the session has cores (one large row group, say) dealt out to all of them, before costly
    work on each row. A larger table has more pieces and is left as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures: a user is a county, an event a capture, its value the content."""
    e = table(spark, sf_dir, "events")
    content = lambda n: F.sha2(F.floor(F.col("value") / n).cast("long").cast("string"), 256)
    return e.select(
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("county"),
        F.element_at(F.array(*[F.lit(p) for p in PAGE_TYPES]), (F.col("event_id") % 5 + 1).cast("int")).alias("page_type"),
        F.col("ts").alias("fetched_at"), F.col("event_id").alias("capture_id"), content(10).alias("html_sha256"), content(40).alias("text_sha256"),
        F.when(F.col("event_id") % 17 == 0, 503).when(F.col("event_id") % 17 == 1, 403).otherwise(200).alias("http_status"),
        F.when(F.col("event_id") % 23 == 0, "timeout").alias("error"),
        F.when(F.col("event_id") % 7 == 0, "headless").otherwise("plain").alias("render_mode"),
        (F.floor(F.col("value") * 10).cast("long") + 1).alias("byte_size"),
        F.concat(F.lit("https://www."), F.col("event_type"), (F.col("user_id") % 9).cast("string"), F.lit(".example.org/"), (F.col("event_id") % 3).cast("string")).alias("final_url"),
        F.when(F.col("event_id") % 11 == 0, "application/pdf").otherwise("text/html").alias("content_type"), F.col("event_type").alias("title"),
    )


HISTORY = f"""history as (select 'c' || user_id as county, {TYPES_SQL}[event_id % 5 + 1] as page_type, ts as fetched_at, event_id as capture_id,
    sha256(cast(cast(floor(value / 10) as bigint) as varchar)) as html_sha256, sha256(cast(cast(floor(value / 40) as bigint) as varchar)) as text_sha256,
    case event_id % 17 when 0 then 503 when 1 then 403 else 200 end as http_status, case when event_id % 23 = 0 then 'timeout' end as error,
    case when event_id % 7 = 0 then 'headless' else 'plain' end as render_mode, cast(floor(value * 10) as bigint) + 1 as byte_size,
    'https://www.' || event_type || (user_id % 9) || '.example.org/' || (event_id % 3) as final_url, case when event_id % 11 = 0 then 'application/pdf' else 'text/html' end as content_type, event_type as title from events)"""
VERSIONS = HISTORY + """, v as (select *, lag(fetched_at) over w as prev_at, lag(html_sha256) over w as ph, lag(text_sha256) over w as pt, lag(error) over w as pe, lag(http_status) over w as ps,
    lag(final_url) over w as pu, lag(render_mode) over w as pm, lag(content_type) over w as ptype, lag(title) over w as ptitle from history window w as (partition by county, page_type order by fetched_at, capture_id)),
    c as (select *, prev_at is not null and (html_sha256 is distinct from ph or text_sha256 is distinct from pt) as changed from v)"""


def counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return c.join(F.broadcast(n), "c_nationkey").select(F.col("c_name").alias("county"), F.when(F.col("c_custkey") % 50 == 0, "").when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") + 1).cast("string"), 9, "0"))).otherwise(F.initcap("n_name")).alias("seat"), (F.col("c_custkey") % 3 + 1).cast("string").alias("batch"), F.lit("").alias("homepage"))


COUNTIES = """counties as (select c_name as county, case when c_custkey % 50 = 0 then '' when c_custkey % 7 = 0 then 'Customer#' || lpad(cast(c_custkey + 1 as varchar), 9, '0')
    else array_to_string(list_transform(string_split(lower(n_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') end as seat, cast(c_custkey % 3 + 1 as varchar) as batch from customer join nation on n_nationkey = c_nationkey)"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rows for each customer."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.posexplode(F.array(*[F.lit(p) for p in PAGE_TYPES])).alias("o", "page_type"))
    k = F.col("c_custkey") * 5 + F.col("o")
    gap = k % 4 == 0
    status = F.when(gap, "gap").when(k % 11 == 0, "broken").otherwise("ok")
    note = F.when(k % 3 == 0, F.concat(F.lit("GAP: published as PDF: "), F.col("c_custkey").cast("string"))).when(k % 3 == 1, F.lit("GAP: candidate unreachable (tried: x)")).otherwise(F.concat(F.lit("GAP: none for "), F.col("c_mktsegment")))
    out = c.select(
        F.col("c_name").alias("county"), (F.col("c_custkey") % 3 + 1).cast("string").alias("batch"), "page_type",
        F.when(gap, "").otherwise(F.concat(F.lit("https://"), F.lower("c_mktsegment"), F.col("c_custkey").cast("string"), F.lit(".example.org/"), F.col("page_type"))).alias("url"),
        F.when(k % 6 == 1, "true").otherwise("false").alias("external"), F.when(gap, note).otherwise(F.when(k % 13 == 0, "externally verified").otherwise("")).alias("notes"), status.alias("verify_status"),
        F.when(status == "ok", "200").otherwise("").alias("http_status"), F.lit("").alias("final_url"),
        F.when(status != "ok", status).when(k % 3 == 0, "confident").when(k % 3 == 1, "likely").otherwise("uncertain").alias("audit_confidence"),
        F.concat(F.lit("[plain] "), F.col("c_mktsegment")).alias("audit_reason"), F.when((status == "broken") | ((status == "ok") & (k % 3 == 2)), "yes").otherwise("").alias("flag_for_review"),
    )
    return out.select(*BASE_COLUMNS, *AUDIT_COLUMNS)


TARGETS = f"""t0 as (select c_custkey, c_name, c_mktsegment, p.o, p.page_type, c_custkey * 5 + p.o as k from customer, (values {ROWS_SQL}) p(o, page_type)),
    t1 as (select *, case when k % 4 = 0 then 'gap' when k % 11 = 0 then 'broken' else 'ok' end as st from t0),
    targets as (select c_name as county, cast(c_custkey % 3 + 1 as varchar) as batch, page_type, case when st = 'gap' then '' else 'https://' || lower(c_mktsegment) || c_custkey || '.example.org/' || page_type end as url,
    case when k % 6 = 1 then 'true' else 'false' end as external,
    case when st = 'gap' then case k % 3 when 0 then 'GAP: published as PDF: ' || c_custkey when 1 then 'GAP: candidate unreachable (tried: x)' else 'GAP: none for ' || c_mktsegment end when k % 13 = 0 then 'externally verified' else '' end as notes,
    st as verify_status, case when st = 'ok' then '200' else '' end as http_status, '' as final_url,
    case when st <> 'ok' then st when k % 3 = 0 then 'confident' when k % 3 = 1 then 'likely' else 'uncertain' end as audit_confidence, '[plain] ' || c_mktsegment as audit_reason,
    case when st = 'broken' or (st = 'ok' and k % 3 = 2) then 'yes' else '' end as flag_for_review, o from t1)"""
ORDINAL = "list_position(" + TYPES_SQL + ", page_type)"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch attempts: an order is a URL, its lines in order attempts that take turns between the protocols."""
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").withColumn("o", nth)
    s = F.col("l_partkey") % 5
    status = F.when(s == 0, 500).when(s == 1, 404).when(s == 2, F.lit(None)).when(s == 3, 200).otherwise(503).cast("int")
    return x.select(
        F.col("l_orderkey").alias("requested_url"), (F.col("o") % 2 == 1).alias("http2"), F.floor((F.col("o") + 1) / 2).cast("int").alias("attempt"), (s != 2).alias("ok"), status.alias("http_status"),
        F.when(s == 2, F.concat(F.lit("timeout "), F.col("l_linenumber").cast("string"))).alias("error"), F.col("l_suppkey").alias("body"),
    )


ATTEMPTS = """lines_in_order as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as nth from lineitem),
    attempts as (select l_orderkey as requested_url, nth % 2 = 1 as http2, (nth + 1) // 2 as attempt, (nth + 1) % 2 * 1000 + (nth + 1) // 2 as o, l_partkey % 5 <> 2 as ok,
    case l_partkey % 5 when 0 then 500 when 1 then 404 when 3 then 200 when 4 then 503 end as http_status, case when l_partkey % 5 = 2 then 'timeout ' || l_linenumber end as error, l_suppkey as body from lines_in_order)"""


def decoded(sql: str) -> str:
    """Character references that the test pages hold, the ampersand last."""
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("#x27", "''"), ("#39", "''"), ("amp", "&")):
        sql = f"replace({sql}, '&{name};', '{char}')"
    return sql


def links_sql(extra: str = "") -> str:
    """Links of pages in order, with absolute URLs."""
    return f"""l0 as (select page_id, url as page, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) as href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) as text,
        unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">', 1)))) as pos from pages),
        links as (select page_id, pos, page, {decoded('href')} as href, {decoded('text')} as text, regexp_extract(page, '^(https?://[^/?#]*)', 1) || {decoded('href')} as url{extra} from l0)"""
