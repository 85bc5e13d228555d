"""The manifest: selection, resumption, merges, coverage and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import gap_reason
from ..functions.values import slug, target_key
from ..functions.vocabulary import AUDIT_COLUMNS, BASE_COLUMNS, PAGE_TYPES
from .order import numbered

KEY = ["county", "page_type"]


def ordinal(page_type: Column) -> Column:
    return F.coalesce(*[F.when(page_type == p, k) for k, p in enumerate(PAGE_TYPES)])


def captured(targets: DataFrame) -> DataFrame:
    """Targets with a URL."""
    return targets.filter(F.trim("url") != "")


def selected(targets: DataFrame, counties: list[str] | None = None, page_types: list[str] | None = None, batch: str | None = None) -> DataFrame:
    """Counties and page types whatever their case; the batch as it is written."""
    for col, wanted in (("county", counties), ("page_type", page_types)):
        if wanted:
            targets = targets.filter(F.lower(F.trim(col)).isin([w.strip().lower() for w in wanted]))
    return targets if batch is None else targets.filter(F.trim("batch") == str(batch))


def remaining(targets: DataFrame, done: DataFrame) -> DataFrame:
    """Targets that a checkpoint does not hold."""
    return targets.withColumn("target_key", target_key(F.col("county"), F.col("page_type"))).join(done, "target_key", "left_anti")


def stale(snapshots: DataFrame, targets: DataFrame) -> DataFrame:
    """Snapshots (slug, page_type) that no target with a URL claims."""
    claimed = captured(targets).select(slug(F.trim("county")).alias("slug"), F.trim("page_type").alias("page_type")).distinct()
    return snapshots.join(claimed, ["slug", "page_type"], "left_anti")


def with_seats(targets: DataFrame, counties: DataFrame) -> DataFrame:
    return targets.join(counties.select("county", "seat").dropDuplicates(["county"]), "county", "left").withColumn("seat", F.coalesce("seat", F.lit("")))


def batch_rows(homes: DataFrame, draft: DataFrame, batch: str) -> DataFrame:
    """Five rows for each county of a batch: its homepage, and the draft's pages or gaps."""
    types = F.explode(F.array(*[F.lit(p) for p in PAGE_TYPES])).alias("page_type")
    rows = homes.select("county", "homepage", "confidence", "evidence", types)
    joined = rows.join(draft.select(*KEY, F.col("url").alias("d_url"), F.col("external").alias("d_external"), F.col("notes").alias("d_notes")), KEY, "left")
    home = F.col("page_type") == "homepage"
    review = F.when(F.col("confidence") != "confident", F.concat(F.lit("REVIEW ("), F.col("confidence"), F.lit("): "), F.col("evidence"))).otherwise(F.col("evidence"))
    missing = F.col("d_url").isNull()
    return joined.select(
        "county", F.lit(batch).alias("batch"), "page_type",
        F.trim(F.when(home, F.col("homepage")).otherwise(F.coalesce("d_url", F.lit("")))).alias("url"),
        F.when(home | missing, "false").otherwise(F.col("d_external")).alias("external"),
        F.when(home, F.substring(F.concat(F.lit("discovered homepage — "), review), 1, 300)).when(missing, F.lit("GAP: not discovered (homepage unreachable during discovery)")).otherwise(F.substring("d_notes", 1, 300)).alias("notes"),
        *[F.lit("").alias(c) for c in AUDIT_COLUMNS],
    )


def replace_batch(existing: DataFrame, new: DataFrame, batch: str) -> DataFrame:
    """Other batches exactly as they are, the batch's rows anew. A missing label is batch 1."""
    cols = BASE_COLUMNS + AUDIT_COLUMNS
    kept = existing.filter(F.trim(F.coalesce("batch", F.lit("1"))) != batch).select(*cols)
    return kept.unionByName(new.select(*cols))


def update_audit(targets: DataFrame, audited: DataFrame) -> DataFrame:
    """Audit columns of the audited targets; the others keep theirs."""
    a = audited.select(*KEY, *[F.col(c).alias(f"_{c}") for c in AUDIT_COLUMNS], F.lit(True).alias("_hit"))
    joined = targets.join(a, KEY, "left")
    return joined.select(*BASE_COLUMNS, *[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in AUDIT_COLUMNS])


def totals(t: DataFrame) -> DataFrame:
    return t.agg(F.countDistinct("county").alias("counties"), F.count("*").alias("n_rows"), *_health())


def _health() -> list[Column]:
    return [
        F.count_if(F.col("verify_status") == "ok").alias("live"),
        F.count_if(F.col("verify_status") == "broken").alias("broken"),
        F.count_if(F.col("verify_status") == "gap").alias("gaps"),
        F.count_if(F.col("flag_for_review") == "yes").alias("flagged"),
    ]


def coverage(t: DataFrame) -> DataFrame:
    """got and rows by page type and batch, with a total for each page type (batch null): one pass."""
    return t.rollup("page_type", "batch").agg(F.count_if(F.trim("url") != "").alias("got"), F.count("*").alias("n_rows")).filter("page_type is not null")


def coverage_cells(t: DataFrame, batches: list[str]) -> DataFrame:
    cell = F.concat_ws("/", F.count_if(F.trim("url") != "").cast("string"), F.count(F.lit(1)).cast("string"))
    wide = t.groupBy("page_type").pivot("batch", batches).agg(cell)
    return wide.join(t.groupBy("page_type").agg(cell.alias("total")), "page_type").select("page_type", *[F.coalesce(F.col(b), F.lit("0/0")).alias(f"batch_{b}") for b in batches], "total")


def external_coverage(t: DataFrame) -> DataFrame:
    there = F.trim("url") != ""
    return t.groupBy("page_type").agg(F.count_if(there).alias("captured"), F.count_if(there & (F.lower(F.trim("external")).isin("true", "1", "yes"))).alias("external"))


def health(t: DataFrame) -> DataFrame:
    return t.groupBy("batch").agg(F.countDistinct("county").alias("counties"), *_health())


def gap_reasons(t: DataFrame, k: int | None = None) -> DataFrame:
    """Reasons of gaps with counts; k: the most frequent, ties by the first in order of county and page type."""
    gaps = t.filter(F.col("verify_status") == "gap").withColumn("reason", gap_reason(F.coalesce("notes", F.lit(""))))
    out = gaps.groupBy("reason").agg(F.count("*").alias("n"), F.min(F.struct("county", ordinal(F.col("page_type")))).alias("first"))
    return (out if k is None else out.orderBy(F.desc("n"), "first").limit(k)).select("reason", "n")


def completeness(t: DataFrame) -> DataFrame:
    """How many counties have how many pages."""
    return t.groupBy("county").agg(F.count_if(F.trim("url") != "").alias("pages")).groupBy("pages").agg(F.count("*").alias("counties"))


def confidences(t: DataFrame, col: str = "audit_confidence") -> DataFrame:
    return t.groupBy(F.col(col).alias("confidence")).agg(F.count("*").alias("n"))


def discovery_summary(draft: DataFrame) -> DataFrame:
    there = F.trim("url") != ""
    return draft.agg(F.count("*").alias("n_rows"), F.count_if(there).alias("with_url"), F.count_if(~there).alias("gaps"))


def broken(t: DataFrame) -> DataFrame:
    """Broken targets and their `position` by batch, county and page type."""
    return numbered(t.filter(F.col("verify_status") == "broken"), "batch", "county", ordinal(F.col("page_type")))


def flagged(t: DataFrame) -> DataFrame:
    """Flagged but not broken, and their `position` by page type, batch and county."""
    return numbered(t.filter((F.col("flag_for_review") == "yes") & (F.col("verify_status") != "broken")), ordinal(F.col("page_type")), "batch", "county")


def in_seed_order(draft: DataFrame, seed_positions: DataFrame) -> DataFrame:
    """seed_positions: county, position."""
    return draft.join(seed_positions, "county").orderBy("position", ordinal(F.col("page_type"))).drop("position")


def numbered_in_seed_order(draft: DataFrame, seed_positions: DataFrame) -> DataFrame:
    """The same rows with their `position` in the whole draft."""
    seeds = seed_positions.select("county", F.col("position").alias("_seed"))
    return numbered(draft.join(seeds, "county"), "_seed", ordinal(F.col("page_type"))).drop("_seed")


def collisions(counties: DataFrame) -> DataFrame:
    """Counties whose seat bears another county's name."""
    other = counties.select(F.col("county").alias("seat"), F.col("seat").alias("other_seat")).distinct()
    return counties.select("county", "seat").join(other, "seat").filter("county <> seat").select("county", "seat", "other_seat")


def seed_union(*batches: tuple[str, DataFrame]) -> DataFrame:
    """One seed of several batches' counties (county, seat, homepage): a county that two name belongs to the first."""
    rows = None
    for k, (label, df) in enumerate(batches):
        own = df.select("county", "seat", F.lit(label).alias("batch"), "homepage", F.lit(k).alias("_k"))
        rows = own if rows is None else rows.unionByName(own)
    first = F.min_by(F.struct("seat", "batch", "homepage"), F.struct("_k", "seat", "homepage"))
    return rows.groupBy("county").agg(first.alias("f")).select("county", "f.*")
