"""Versions of pages over runs: what changed, when, and how.

A target is compared with its own previous capture, not with the previous run. A content change is a change of
either hash. Windows are over one target's captures, so no window grows with the number of targets.

A history may have a column `deleted`: such a row is no capture but says that the target went at that time (a tombstone). A
target that has gone is in no state, and its next capture is a first one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import registered_domain
from ..functions.values import sha256

HASHES = ["html_sha256", "text_sha256"]


def gone(history: DataFrame) -> Column:
    return F.coalesce("deleted", F.lit(False)) if "deleted" in history.columns else F.lit(False)


def _order(history: DataFrame) -> list[Column]:
    """Time; ties by capture_id if there is one."""
    return [F.col(c) for c in ("fetched_at", "capture_id") if c in history.columns]


def versions(history: DataFrame, keys: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """Each capture with its previous one's values (prev_*); none if the target had gone in between."""
    w = Window.partitionBy(*keys).orderBy(*_order(history))
    live = ~gone(history)
    before = lambda c: F.lag(F.when(live, F.col(c))).over(w)
    out = history.select("*", before("fetched_at").alias("prev_at"), *[before(c).alias(f"prev_{c}") for c in (*HASHES, *extra)])
    return out.filter(live)


def deletions(history: DataFrame, keys: list[str]) -> DataFrame:
    """Tombstones of targets that were there: what a run's D rows are."""
    w = Window.partitionBy(*keys).orderBy(*_order(history))
    there = F.coalesce(F.lag(~gone(history)).over(w), F.lit(False))
    return history.withColumn("_there", there).filter(gone(history) & F.col("_there")).drop("_there")


def page_log(history: DataFrame, keys: list[str]) -> DataFrame:
    """The whole log of targets: A (first, or first after a deletion), M (other content) and D, with the time."""
    v = versions(history, keys).withColumn("status", F.when(F.col("prev_at").isNull(), "A").when(changed(), "M")).filter("status is not null")
    cols = [*keys, "fetched_at", *HASHES]
    return v.select(*cols, "status").unionByName(deletions(history, keys).select(*cols, F.lit("D").alias("status")))


def changed() -> Column:
    """Of versions(): a capture whose content is not that of the one before; a first capture is no change."""
    different = F.lit(False)
    for c in HASHES:
        different = different | ~F.col(c).eqNullSafe(F.col(f"prev_{c}"))
    return F.col("prev_at").isNotNull() & different


def changes(history: DataFrame, keys: list[str]) -> DataFrame:
    return versions(history, keys).filter(changed())


def gaps(history: DataFrame, keys: list[str], silence: str, until: Column) -> DataFrame:
    """keys, last_at, stale_at: captures after which a target was silent for longer than `silence` (an interval, as '6 hours').
    A target's last capture counts if its silence has ended before `until`; a deletion is no silence."""
    w = Window.partitionBy(*keys).orderBy(*_order(history))
    stale = F.col("fetched_at") + F.expr(f"interval {silence}")
    out = history.select(*keys, F.col("fetched_at").alias("last_at"), stale.alias("stale_at"), F.lead("fetched_at").over(w).alias("_next"), gone(history).alias("_gone"))
    return out.filter(~F.col("_gone") & (F.coalesce("_next", until) > F.col("stale_at"))).select(*keys, "last_at", "stale_at")


def distinct_versions(history: DataFrame, keys: list[str]) -> DataFrame:
    """The log of a page: captures that begin a new content, the first included."""
    return versions(history, keys).filter(F.col("prev_at").isNull() | changed())


def as_of(history: DataFrame, keys: list[str], at: Column, columns: list[str]) -> DataFrame:
    """The last capture of each target at a time or before it, if it had not gone since: one aggregate, no sort."""
    last = F.max_by(F.struct("fetched_at", *columns, gone(history).alias("_gone")), F.struct(*_order(history)))
    return history.filter(F.col("fetched_at") <= at).groupBy(*keys).agg(last.alias("s")).select(*keys, "s.*").filter("not _gone").drop("_gone")


def between(history: DataFrame, keys: list[str], before: Column, after: Column) -> DataFrame:
    """State at two times side by side (b, a), from one pass over the history and one shuffle; null where a target was not there."""
    s = F.struct("fetched_at", *HASHES, gone(history).alias("_gone"))
    order = F.struct(*_order(history))
    early = F.col("fetched_at") <= before
    both = history.filter(F.col("fetched_at") <= after).groupBy(*keys).agg(F.max_by(F.when(early, s), F.when(early, order)).alias("b"), F.max_by(s, order).alias("a"))
    return both.select(*keys, *[F.when(~F.col(f"{x}._gone"), F.col(x).dropFields("_gone")).alias(x) for x in "ba"])


def diff(history: DataFrame, keys: list[str], before: Column, after: Column) -> DataFrame:
    """A (new), M (other content) or D (gone) for each target that differs between two times."""
    both = between(history, keys, before, after)
    other = ~F.col("a.html_sha256").eqNullSafe(F.col("b.html_sha256")) | ~F.col("a.text_sha256").eqNullSafe(F.col("b.text_sha256"))
    there = lambda x: F.col(f"{x}.fetched_at").isNotNull()
    status = F.when(~there("b") & there("a"), "A").when(there("b") & ~there("a"), "D").when(there("b") & other, "M")
    return both.select(*keys, status.alias("status")).filter("status is not null")


def run_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A, M or D for each target of two states (keys, html_sha256, text_sha256): D is in the old one alone."""
    o = old.select(*keys, *[F.col(c).alias(f"o_{c}") for c in HASHES], F.lit(1).alias("_o"))
    n = new.select(*keys, *HASHES, F.lit(1).alias("_n"))
    j = o.join(n, keys, "full_outer")
    same = F.lit(True)
    for c in HASHES:
        same = same & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    status = F.when(F.col("_o").isNull(), "A").when(F.col("_n").isNull(), "D").when(~same, "M")
    return j.select(*keys, status.alias("status")).filter("status is not null")


def metadata_flags(history: DataFrame, keys: list[str]) -> DataFrame:
    """Which of the facts about a page are not those of its previous capture."""
    facts = ("final_url", "http_status", "content_type", "render_mode", "title")
    v = versions(history, keys, facts).filter("prev_at is not null")
    flag = lambda c: ~F.col(c).eqNullSafe(F.col(f"prev_{c}"))
    vendor = ~registered_domain(F.col("final_url")).eqNullSafe(registered_domain(F.col("prev_final_url")))
    return v.select(*keys, "fetched_at", flag("final_url").alias("redirect_changed"), vendor.alias("vendor_changed"), flag("http_status").alias("status_changed"), flag("content_type").alias("type_changed"), flag("render_mode").alias("mode_changed"), flag("title").alias("title_changed"))


def classified(history: DataFrame, keys: list[str]) -> DataFrame:
    """unchanged, content or access for each capture after the first; status_suspect: a content change with a status of 400 or more on either side."""
    v = versions(history, keys, ("error", "http_status")).filter("prev_at is not null")
    failed = F.col("error").isNotNull() | F.col("prev_error").isNotNull()
    kind = F.when(failed, "access").when(changed(), "content").otherwise("unchanged")
    bad = (F.coalesce("http_status", F.lit(0)) >= 400) | (F.coalesce("prev_http_status", F.lit(0)) >= 400)
    return v.select(*v.columns, kind.alias("change"), ((kind == "content") & bad).alias("status_suspect"))


def run_log(history: DataFrame, keys: list[str], run: Column) -> DataFrame:
    """For each run: targets, changed ones, errors, rendered ones, bytes, and whether nothing changed."""
    v = versions(history, keys).withColumn("run", run).withColumn("_c", changed())
    counts = [F.count("*").alias("n_targets"), F.count_if(F.col("_c")).alias("n_changed"), F.count_if(F.col("error").isNotNull()).alias("n_errors"), F.count_if(F.col("render_mode") == "headless").alias("n_headless"), F.sum("byte_size").alias("bytes")]
    return v.groupBy("run").agg(*counts).withColumn("zero_diff", F.col("n_changed") == 0)


def violations(history: DataFrame, keys: list[str], run: Column, first: str, second: str) -> DataFrame:
    """Targets whose content differs between two runs that should agree."""
    h = history.withColumn("run", run)
    return run_diff(h.filter(F.col("run") == first), h.filter(F.col("run") == second), keys).filter("status = 'M'")


def line_changes(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Added and removed lines of pairs (keys, before, after), as multisets: line, removed, added.

    Only pairs that differ go on; lines travel as hashes until they are known to differ.
    """
    differ = pairs.filter(~F.col("before").eqNullSafe(F.col("after")))
    old = differ.select(*keys, F.explode(F.split(F.coalesce("before", F.lit("")), "\n")).alias("line"), F.lit(1).alias("o"), F.lit(0).alias("n"))
    new = differ.select(*keys, F.explode(F.split(F.coalesce("after", F.lit("")), "\n")).alias("line"), F.lit(0).alias("o"), F.lit(1).alias("n"))
    both = old.unionByName(new).groupBy(*keys, "line").agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    return both.filter("o <> n").select(*keys, "line", F.greatest(F.col("o") - F.col("n"), F.lit(0)).alias("removed"), F.greatest(F.col("n") - F.col("o"), F.lit(0)).alias("added"))


def diff_stat(lines: DataFrame, keys: list[str]) -> DataFrame:
    return lines.groupBy(*keys).agg(F.sum("added").alias("insertions"), F.sum("removed").alias("deletions"))


def change_counts(history: DataFrame, keys: list[str], *by: Column) -> DataFrame:
    return changes(history, keys).groupBy(*by).agg(F.count("*").alias("n_changes"))


def storage_growth(history: DataFrame, run: Column) -> DataFrame:
    """Bytes of bodies that a run is the first to hold."""
    first = history.groupBy("html_sha256").agg(F.min(run).alias("run"), F.max("byte_size").alias("byte_size"))
    return first.groupBy("run").agg(F.sum("byte_size").alias("new_bytes"), F.count("*").alias("new_bodies"))


def shared_content(pages: DataFrame, content: str, member: str) -> DataFrame:
    """Contents that several members have; empty ones do not count. Members are counted, with the first and last by name."""
    empty = F.sha2(F.lit("").cast("binary"), 256)
    held = pages.filter(F.col(content).isNotNull() & (F.col(content) != empty))
    return held.groupBy(content).agg(F.countDistinct(member).alias("members"), F.min(member).alias("first_member"), F.max(member).alias("last_member")).filter("members > 1")


def text_hashes(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("text_sha256", sha256(F.col(col)))
