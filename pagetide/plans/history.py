"""Change tracking over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values as X
from ..operators import history as H
from ..operators import hunks as U
from ..operators.crawl import shared_folder
from ..sources.bodies import add_bodies, lines_between
from ..streaming.changes import per_window
from .inputs import HISTORY, KEYS, VERSIONS, history
from .registry import query

KS = "county, page_type"
RUN = lambda: F.to_date("fetched_at")
T1, T2 = "2024-01-10 00:00:00", "2024-01-20 00:00:00"


def at(t: str):
    return F.to_timestamp(F.lit(t))


@query("changes_per_day", f"with {VERSIONS} select cast(fetched_at as date) as run, count(*) as n_changes from c where changed group by all")
def changes_per_day(spark, d):
    """Captures whose content is not that of the target's capture before, counted by day."""
    return H.change_counts(history(spark, d), KEYS, RUN().alias("run"))


@query("changed_captures", f"with {VERSIONS} select {KS}, fetched_at, capture_id, ph as prev_html_sha256, html_sha256 from c where changed")
def changed_captures(spark, d):
    return H.changes(history(spark, d), KEYS).select(*KEYS, "fetched_at", "capture_id", "prev_html_sha256", "html_sha256")


@query("page_log", f"with {VERSIONS} select {KS}, fetched_at, capture_id, html_sha256 from c where prev_at is null or changed")
def page_log(spark, d):
    return H.distinct_versions(history(spark, d), KEYS).select(*KEYS, "fetched_at", "capture_id", "html_sha256")


SILENT, UNTIL = "4 days", "2024-01-30 00:00:00"


@query("stale_targets", f"""with {HISTORY}, n as (select {KS}, fetched_at as last_at, fetched_at + interval {SILENT} as stale_at, lead(fetched_at) over (partition by {KS} order by fetched_at, capture_id) as next from history)
    select {KS}, last_at, stale_at from n where coalesce(next, timestamp '{UNTIL}') > stale_at""")
def stale_targets(spark, d):
    """Targets that fell silent for longer than a few cadences."""
    return H.gaps(history(spark, d), KEYS, SILENT, at(UNTIL))


LAST = "arg_max({x}, (fetched_at, capture_id))"


@query("state_as_of", f"with {HISTORY} select {KS}, arg_max(fetched_at, (fetched_at, capture_id)) as fetched_at, arg_max(html_sha256, (fetched_at, capture_id)) as html_sha256, arg_max(http_status, (fetched_at, capture_id)) as http_status from history where fetched_at <= timestamp '{T1}' group by all")
def state_as_of(spark, d):
    return H.as_of(history(spark, d), KEYS, at(T1), ["html_sha256", "http_status"])


def _state(t):
    return f"select {KS}, arg_max(html_sha256, (fetched_at, capture_id)) as html_sha256, arg_max(text_sha256, (fetched_at, capture_id)) as text_sha256 from history where fetched_at <= timestamp '{t}' group by all"


@query("before_after", f"with {HISTORY}, b as ({_state(T1)}), a as ({_state(T2)}) select a.county, a.page_type, case when b.county is null then 'A' else 'M' end as status from a left join b using (county, page_type) where a.html_sha256 is distinct from b.html_sha256 or a.text_sha256 is distinct from b.text_sha256")
def before_after(spark, d):
    return H.diff(history(spark, d), KEYS, at(T1), at(T2))


def _day(t):
    return f"select {KS}, arg_max(html_sha256, (fetched_at, capture_id)) as html_sha256, arg_max(text_sha256, (fetched_at, capture_id)) as text_sha256 from history where cast(fetched_at as date) = date '{t}' group by all"


def _of_day(spark, d, day):
    h = history(spark, d).filter(F.to_date("fetched_at") == F.lit(day).cast("date"))
    return H.as_of(h, KEYS, at("2100-01-01 00:00:00"), ["html_sha256", "text_sha256"])


@query("run_diff", f"with {HISTORY}, o as ({_day('2024-01-10')}), n as ({_day('2024-01-11')}) select county, page_type, case when o.html_sha256 is null then 'A' when n.html_sha256 is null then 'D' else 'M' end as status from o full join n using (county, page_type) where o.html_sha256 is distinct from n.html_sha256 or o.text_sha256 is distinct from n.text_sha256")
def run_diff(spark, d):
    return H.run_diff(_of_day(spark, d, "2024-01-10"), _of_day(spark, d, "2024-01-11"), KEYS)


@query("determinism_violations", f"with {HISTORY}, o as ({_day('2024-01-10')}), n as ({_day('2024-01-11')}) select county, page_type, 'M' as status from o join n using (county, page_type) where o.html_sha256 <> n.html_sha256 or o.text_sha256 <> n.text_sha256")
def determinism_violations(spark, d):
    a, b = _of_day(spark, d, "2024-01-10").withColumn("run", F.lit("1")), _of_day(spark, d, "2024-01-11").withColumn("run", F.lit("2"))
    return H.violations(a.unionByName(b), KEYS, F.col("run"), "1", "2")


# three in eleven events say that their target has gone
GONE = HISTORY + """, gone as (select * replace (case when capture_id % 11 < 3 then null else html_sha256 end as html_sha256, case when capture_id % 11 < 3 then null else text_sha256 end as text_sha256), capture_id % 11 < 3 as deleted from history),
    steps as (select *, lag(deleted) over w as pd, lag(html_sha256) over w as ph, lag(text_sha256) over w as pt from gone window w as (partition by county, page_type order by fetched_at, capture_id)),
    logged as (select county, page_type, fetched_at, capture_id, html_sha256, case when deleted then case when not pd then 'D' end when pd is null or pd then 'A' when html_sha256 <> ph or text_sha256 <> pt then 'M' end as status from steps)"""


def history_with_deletions(spark, d):
    """Captures of which three in eleven are tombstones instead."""
    h = history(spark, d).withColumn("deleted", F.col("capture_id") % 11 < 3)
    return h.withColumns({c: F.when(~F.col("deleted"), F.col(c)) for c in H.HASHES})


@query("page_log_with_deletions", f"with {GONE} select {KS}, fetched_at, html_sha256, status from logged where status is not null")
def page_log_with_deletions(spark, d):
    return H.page_log(history_with_deletions(spark, d), KEYS).drop("text_sha256")


@query("deletions_per_day", f"with {GONE} select cast(fetched_at as date) as run, count(*) as n_deleted from logged where status = 'D' group by all")
def deletions_per_day(spark, d):
    return H.deletions(history_with_deletions(spark, d), KEYS).groupBy(RUN().alias("run")).agg(F.count("*").alias("n_deleted"))


def _live(t):
    return f"select {KS}, arg_max(struct_pack(at := fetched_at, html := html_sha256, gone := deleted), (fetched_at, capture_id)) as s from gone where fetched_at <= timestamp '{t}' group by all"


@query("state_with_deletions", f"with {GONE}, s as ({_live(T1)}) select {KS}, s.at as fetched_at, s.html as html_sha256 from s where not s.gone")
def state_with_deletions(spark, d):
    return H.as_of(history_with_deletions(spark, d), KEYS, at(T1), ["html_sha256"])


@query("diff_with_deletions", f"with {GONE}, b as (select * from ({_live(T1)}) where not s.gone), a as (select * from ({_live(T2)}) where not s.gone) select {KS}, case when b.s is null then 'A' when a.s is null then 'D' else 'M' end as status from b full join a using (county, page_type) where a.s.html is distinct from b.s.html")
def diff_with_deletions(spark, d):
    return H.diff(history_with_deletions(spark, d), KEYS, at(T1), at(T2))


DOMAIN = "regexp_extract({u}, '([^./]*\\.[^./]*)/[0-9]*$', 1)"


@query("metadata_changes", f"with {VERSIONS} select {KS}, fetched_at, final_url is distinct from pu as redirect_changed, {DOMAIN.format(u='final_url')} is distinct from {DOMAIN.format(u='pu')} as vendor_changed, http_status is distinct from ps as status_changed, content_type is distinct from ptype as type_changed, render_mode is distinct from pm as mode_changed, title is distinct from ptitle as title_changed from c where prev_at is not null")
def metadata_changes(spark, d):
    return H.metadata_flags(history(spark, d), KEYS)


@query("classified_changes", f"with {VERSIONS}, k as (select *, case when error is not null or pe is not null then 'access' when changed then 'content' else 'unchanged' end as change from c where prev_at is not null) select change, change = 'content' and (http_status >= 400 or ps >= 400) as status_suspect, count(*) as n from k group by all")
def classified_changes(spark, d):
    return H.classified(history(spark, d), KEYS).groupBy("change", "status_suspect").agg(F.count("*").alias("n"))


@query("run_log", f"with {VERSIONS} select cast(fetched_at as date) as run, count(*) as n_targets, count(*) filter (changed) as n_changed, count(error) as n_errors, count(*) filter (render_mode = 'headless') as n_headless, cast(sum(byte_size) as bigint) as bytes, count(*) filter (changed) = 0 as zero_diff from c group by 1")
def run_log(spark, d):
    return H.run_log(history(spark, d), KEYS, RUN())


@query("changes_by_type_and_county", f"with {VERSIONS} select county, page_type, count(*) as n_changes from c where changed group by cube (county, page_type)")
def changes_cube(spark, d):
    return H.changes(history(spark, d), KEYS).cube(*KEYS).agg(F.count("*").alias("n_changes"))


@query("storage_growth", f"with {HISTORY}, f as (select html_sha256, min(cast(fetched_at as date)) as run, max(byte_size) as b from history group by 1) select run, cast(sum(b) as bigint) as new_bytes, count(*) as new_bodies from f group by 1")
def storage_growth(spark, d):
    return H.storage_growth(history(spark, d), RUN())


@query("changes_per_window", f"with {VERSIONS} select time_bucket(interval '3 hours', fetched_at, timestamp '1970-01-01') as start, time_bucket(interval '3 hours', fetched_at, timestamp '1970-01-01') + interval '3 hours' as \"end\", count(*) as n_changes from c where changed group by all")
def changes_per_window(spark, d):
    return per_window(H.changes(history(spark, d), KEYS))


@query("usable_captures", f"with {HISTORY} select http_status, count(*) as n from history where error is null group by 1")
def usable_captures(spark, d):
    from ..functions.rules import usable

    return history(spark, d).filter(usable(F.col("error"))).groupBy("http_status").agg(F.count("*").alias("n"))


TURNS = """p as (select conv_id, role, turn, text, lag(text) over (partition by conv_id, role order by turn) as before from conversations),
    x as (select conv_id, role, turn, before, text as after from p where before is not null and before <> text),
    l as (select conv_id, role, turn, unnest(string_split(before, chr(10))) as line, 1 as o, 0 as n from x union all select conv_id, role, turn, unnest(string_split(after, chr(10))), 0, 1 from x),
    m as (select conv_id, role, turn, line, cast(sum(o) as bigint) as o, cast(sum(n) as bigint) as n from l group by all having sum(o) <> sum(n))"""


def _turns(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return c.withColumn("before", F.lag("text").over(w)).filter("before is not null").select("conv_id", "role", "turn", "before", F.col("text").alias("after"))


@query("line_changes", f"with {TURNS} select conv_id, role, turn, line, greatest(o - n, 0) as removed, greatest(n - o, 0) as added from m")
def line_changes(spark, d):
    """Turns of one speaker stand for versions of a page."""
    return H.line_changes(_turns(spark, d), ["conv_id", "role", "turn"])


@query("diff_stat", f"with {TURNS} select conv_id, role, turn, cast(sum(greatest(n - o, 0)) as bigint) as insertions, cast(sum(greatest(o - n, 0)) as bigint) as deletions from m group by all")
def diff_stat(spark, d):
    keys = ["conv_id", "role", "turn"]
    return H.diff_stat(H.line_changes(_turns(spark, d), keys), keys)


@query("line_hunks")
def line_hunks(spark, d):
    """Ordered hunks: removed and added lines with their places."""
    h = _turns(spark, d).select("conv_id", "role", "turn", F.explode(U.line_hunks(F.col("before"), F.col("after"))).alias("h"))
    return h.select("conv_id", "role", "turn", "h.op", "h.pos", "h.line")


def _patched(t, *keys):
    """Hash of the patched old version, and how many lines it has grown by."""
    t = t.withColumn("h", U.line_hunks(F.col("before"), F.col("after")))
    signs = F.transform("h", lambda h: F.when(h["op"] == "+", 1).otherwise(-1))
    grown = F.aggregate(signs, F.lit(0), lambda s, x: s + x)
    return t.select(*keys, X.sha256(U.patched(F.col("before"), F.col("h"))).alias("text_sha256"), grown.cast("long").alias("grown"))


@query("patched_versions", f"with {TURNS} select conv_id, role, turn, sha256(text) as text_sha256, len(string_split(text, chr(10))) - len(string_split(before, chr(10))) as grown from p where before is not null")
def patched_versions(spark, d):
    """Hunks applied to the version before give the version after."""
    return _patched(_turns(spark, d), "conv_id", "role", "turn")


@query("patched_documents", """with v as (select a.doc_id, coalesce(a.text, '') as text, coalesce(b.text, '') as before from documents a left join documents b on b.doc_id + 1 = a.doc_id)
    select doc_id, sha256(text) as text_sha256, len(string_split(text, chr(10))) - len(string_split(before, chr(10))) as grown from v""")
def patched_documents(spark, d):
    """The document before as the old version: many lines, few of them shared."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    old = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("before"))
    return _patched(docs.join(old, "doc_id", "left").select("doc_id", "before", F.col("text").alias("after")), "doc_id")


@query("shared_texts", "select sha256(text) as text_sha256, count(distinct doc_id) as members, min(doc_id) as first_member, max(doc_id) as last_member from documents where text is not null and text <> '' group by 1 having count(distinct doc_id) > 1")
def shared_texts(spark, d):
    return H.shared_content(H.text_hashes(spark.read.parquet(f"{d}/documents.parquet"), "text"), "text_sha256", "doc_id")


@query("new_blobs", "with b as (select sha256(text) as sha256, min(doc_id) as i from documents where text is not null group by 1) select sha256 from b where sha256 not in (select sha256(text) from documents where doc_id % 4 = 0 and text is not null)")
def new_blobs(spark, d):
    """The store holds every fourth document already."""
    from ..sources.tables import new_blobs as blobs

    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("text").alias("body"))
    return blobs(docs, blobs(docs.filter("doc_id % 4 = 0"), None)).select("sha256")


ARCHIVE = f"""a0 as (select user_id, event_id % 5 as kind, ts, event_id, sha256(text) as sha, text from events join documents on doc_id = event_id % (select count(*) from documents) where text is not null),
    o as (select user_id, kind, arg_max(sha, (ts, event_id)) as sha, arg_max(text, (ts, event_id)) as text from a0 where ts <= timestamp '{T1}' group by all),
    w as (select user_id, kind, arg_max(sha, (ts, event_id)) as sha, arg_max(text, (ts, event_id)) as text from a0 where ts <= timestamp '{T2}' group by all),
    x as (select w.user_id, w.kind, o.text as before, w.text as after from w join o using (user_id, kind) where o.sha <> w.sha),
    l as (select user_id, kind, unnest(string_split(before, chr(10))) as line, 1 as o, 0 as n from x union all select user_id, kind, unnest(string_split(after, chr(10))), 0, 1 from x)"""


@query("archived_lines", f"with {ARCHIVE} select user_id, kind, sha256(line) as line_sha256, cast(greatest(sum(o) - sum(n), 0) as bigint) as removed, cast(greatest(sum(n) - sum(o), 0) as bigint) as added from l group by user_id, kind, line having sum(o) <> sum(n)")
def archived_lines(spark, d):
    """Users' pages show one document after the other; their lines between two times come from hashes and a store of bodies."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("text").alias("body")).filter("body is not null")
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", (F.col("event_id") % 5).alias("kind"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("capture_id"), (F.col("event_id") % n).alias("doc_id"))
    sha = X.sha256(F.col("body"))
    h = e.join(docs, "doc_id").select("user_id", "kind", "fetched_at", "capture_id", sha.alias("html_sha256"), sha.alias("text_sha256"))
    name = f"bodies_{uuid.uuid4().hex[:12]}"
    add_bodies(docs, name, f"{shared_folder(spark)}/{name}")
    s = H.between(h, ["user_id", "kind"], at(T1), at(T2)).select("user_id", "kind", F.col("b.html_sha256").alias("before_sha256"), F.col("a.html_sha256").alias("after_sha256"))
    lines = lines_between(s, ["user_id", "kind"], spark, name)
    return lines.select("user_id", "kind", X.sha256(F.col("line")).alias("line_sha256"), "removed", "added")
