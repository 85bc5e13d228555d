"""Manifest, audit report and integrity over the customer table; attempts over lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import externally_confirmed, gap_reason, parse_external
from ..functions.values import slug
from ..operators import captures as C
from ..operators import integrity as Q
from ..operators import manifest as M
from ..operators.order import numbered
from .inputs import ATTEMPTS, COUNTIES, TARGETS, attempts, counties, targets
from .registry import query

HEALTH = "count(*) filter (verify_status = 'ok') as live, count(*) filter (verify_status = 'broken') as broken, count(*) filter (verify_status = 'gap') as gaps, count(*) filter (flag_for_review = 'yes') as flagged"
REASON = "trim(regexp_replace(replace(notes, 'GAP: ', ''), '[:(].*', ''))[1:52]"


@query("manifest_totals", f"with {TARGETS} select count(distinct county) as counties, count(*) as n_rows, {HEALTH} from targets")
def totals(spark, d):
    return M.totals(targets(spark, d))


@query("coverage_rollup", f"with {TARGETS} select page_type, batch, count(*) filter (url <> '') as got, count(*) as n_rows from targets group by rollup (page_type, batch) having page_type is not null")
def coverage(spark, d):
    return M.coverage(targets(spark, d))


CELL = "(count(*) filter (url <> '' and {w})) || '/' || (count(*) filter ({w}))"


@query("coverage_cells", f"with {TARGETS} select page_type, " + ", ".join(CELL.format(w=f"batch = '{b}'") + f" as batch_{b}" for b in (1, 2, 3)) + ", " + CELL.format(w="true") + " as total from targets group by 1")
def coverage_cells(spark, d):
    return M.coverage_cells(targets(spark, d), ["1", "2", "3"])


@query("external_coverage", f"with {TARGETS} select page_type, count(*) filter (url <> '') as captured, count(*) filter (url <> '' and external = 'true') as external from targets group by 1")
def external_coverage(spark, d):
    return M.external_coverage(targets(spark, d))


@query("health_by_batch", f"with {TARGETS} select batch, count(distinct county) as counties, {HEALTH} from targets group by 1")
def health(spark, d):
    return M.health(targets(spark, d))


@query("gap_reasons", f"with {TARGETS} select {REASON} as reason, count(*) as n from targets where verify_status = 'gap' group by 1")
def gap_reasons(spark, d):
    return M.gap_reasons(targets(spark, d))


@query("top_gap_reasons", f"with {TARGETS} select reason, n from (select {REASON} as reason, count(*) as n, min((county, o)) as f from targets where verify_status = 'gap' group by 1 order by n desc, f limit 3)")
def top_gap_reasons(spark, d):
    return M.gap_reasons(targets(spark, d), 3)


@query("completeness", f"with {TARGETS}, p as (select county, count(*) filter (url <> '') as pages from targets group by 1) select pages, count(*) as counties from p group by 1")
def completeness(spark, d):
    return M.completeness(targets(spark, d))


@query("confidence_tally", f"with {TARGETS} select audit_confidence as confidence, count(*) as n from targets group by 1")
def confidences(spark, d):
    return M.confidences(targets(spark, d))


@query("discovery_summary", f"with {TARGETS} select count(*) as n_rows, count(*) filter (url <> '') as with_url, count(*) filter (url = '') as gaps from targets where page_type <> 'homepage'")
def discovery_summary(spark, d):
    return M.discovery_summary(targets(spark, d).filter("page_type <> 'homepage'"))


@query("broken_list", f"with {TARGETS} select batch, county, page_type, audit_reason, row_number() over (order by batch, county, o) as position from targets where verify_status = 'broken'")
def broken(spark, d):
    return M.broken(targets(spark, d)).select("batch", "county", "page_type", "audit_reason", "position")


@query("flagged_list", f"with {TARGETS} select page_type, batch, county, audit_confidence, row_number() over (order by o, batch, county) as position from targets where flag_for_review = 'yes' and verify_status <> 'broken'")
def flagged(spark, d):
    return M.flagged(targets(spark, d)).select("page_type", "batch", "county", "audit_confidence", "position")


@query("selected_targets", f"with {TARGETS} select county, page_type, url, replace(lower(county), ' ', '_') as slug, external = 'true' as is_external from targets where url <> '' and lower(page_type) in ('polling', 'results') and batch = '2'")
def selected(spark, d):
    t = M.selected(M.captured(targets(spark, d)), page_types=["POLLING ", "results"], batch="2")
    return t.select("county", "page_type", "url", slug(F.col("county")).alias("slug"), parse_external(F.col("external")).alias("is_external"))


@query("resumed_targets", f"with {TARGETS} select county || '/' || page_type as target_key from targets where url <> '' and batch <> '3'")
def resumed(spark, d):
    from ..functions.values import target_key

    t = M.captured(targets(spark, d))
    done = t.filter("batch = '3'").select(target_key(F.col("county"), F.col("page_type")).alias("target_key"))
    return M.remaining(t, done).select("target_key")


@query("stale_snapshots", f"with {TARGETS} select replace(lower(county), ' ', '_') as slug, page_type from targets where url = '' and batch = '1'")
def stale(spark, d):
    """Snapshots stand for all of the first batch's rows; its gaps claim none of theirs."""
    t = targets(spark, d)
    return M.stale(t.filter("batch = '1'").select(slug(F.col("county")).alias("slug"), "page_type"), t)


@query("targets_with_seats", f"with {TARGETS}, {COUNTIES} select county, page_type, coalesce(seat, '') as seat from targets left join counties using (county) where url <> ''")
def with_seats(spark, d):
    return M.with_seats(M.captured(targets(spark, d)), counties(spark, d)).select("county", "page_type", "seat")


MERGED = f"""{TARGETS}, homes as (select county, seat, case when cast(right(county, 4) as int) % 2 = 0 then 'confident' else 'likely' end as confidence from cts where batch = '2'),
    m as (select h.county, '2' as batch, p.page_type, case when p.page_type = 'homepage' then 'https://' || lower(replace(h.county, '#', '')) || '.gov/' else coalesce(t.url, '') end as url,
    case when p.page_type = 'homepage' or t.url is null then 'false' else t.external end as external,
    case when p.page_type = 'homepage' then ('discovered homepage — ' || case when confidence <> 'confident' then 'REVIEW (' || confidence || '): ' else '' end || 'seen in ' || seat)[1:300]
         when t.url is null then 'GAP: not discovered (homepage unreachable during discovery)' else t.notes[1:300] end as notes
    from homes h, (values ('homepage'), ('elections'), ('polling'), ('early_voting'), ('results')) p(page_type) left join (select * from targets where url <> '') t on t.county = h.county and t.page_type = p.page_type)"""


@query("merged_batch", f"with {COUNTIES.replace('counties as', 'cts as', 1)}, {MERGED} select county, batch, page_type, url, external, notes, verify_status from targets where batch <> '2' union all select county, batch, page_type, url, external, notes, '' from m")
def merged_batch(spark, d):
    t = targets(spark, d)
    homes = counties(spark, d).filter("batch = '2'").select("county", F.concat(F.lit("https://"), F.lower(F.replace("county", F.lit("#"), F.lit(""))), F.lit(".gov/")).alias("homepage"), F.when(F.substring("county", -4, 4).cast("int") % 2 == 0, "confident").otherwise("likely").alias("confidence"), F.concat(F.lit("seen in "), F.col("seat")).alias("evidence"))
    draft = t.filter("url <> '' and page_type <> 'homepage'")
    return M.replace_batch(t, M.batch_rows(homes, draft, "2"), "2").select("county", "batch", "page_type", "url", "external", "notes", "verify_status")


@query("updated_audit", f"with {TARGETS} select county, page_type, case when batch = '1' then 'uncertain' else audit_confidence end as audit_confidence, case when batch = '1' then 'again' else audit_reason end as audit_reason from targets")
def updated_audit(spark, d):
    t = targets(spark, d)
    return M.update_audit(t, t.filter("batch = '1'").withColumns({"audit_confidence": F.lit("uncertain"), "audit_reason": F.lit("again")})).select("county", "page_type", "audit_confidence", "audit_reason")


@query("name_collisions", f"with {COUNTIES} select a.county, a.seat, b.seat as other_seat from counties a join counties b on a.seat = b.county where a.county <> a.seat")
def collisions(spark, d):
    return M.collisions(counties(spark, d))


@query("draft_positions", f"with {TARGETS} select county, page_type, url, row_number() over (order by county, o) as position from targets where page_type <> 'homepage'")
def draft_positions(spark, d):
    """Counties in order of their names are the seed; the draft takes its places from theirs."""
    t = targets(spark, d).filter("page_type <> 'homepage'").select("county", "page_type", "url")
    return M.numbered_in_seed_order(t, numbered(t.select("county").distinct(), "county"))


@query("gap_notes", f"with {TARGETS} select county, page_type, {REASON} as reason, lower(notes) like '%externally verified%' as confirmed from targets where notes <> ''")
def gap_notes(spark, d):
    return targets(spark, d).filter("notes <> ''").select("county", "page_type", gap_reason(F.col("notes")).alias("reason"), externally_confirmed(F.col("notes")).alias("confirmed"))


ARBITRATED = f"""{ATTEMPTS}, r as (select *, http_status is not null and not (http_status >= 500 and attempt < 4) as kept from attempts),
    k as (select requested_url, case when bool_or(http_status < 400) then arg_min(body, o) filter (http_status < 400) when bool_or(kept) then arg_max(body, o) filter (kept) else arg_max(body, o) end as body,
    case when bool_or(http_status < 400) then arg_min(http_status, o) filter (http_status < 400) when bool_or(kept) then arg_max(http_status, o) filter (kept) end as http_status,
    case when bool_or(http_status < 400) or bool_or(kept) then null else 'plain_fetch_error: ' || coalesce((arg_max(struct_pack(e := error), o)).e, '') end as error from r group by 1)"""


@query("arbitrated_attempts", f"with {ARBITRATED} select requested_url, body, http_status, error from k")
def arbitrated(spark, d):
    return C.arbitrated(attempts(spark, d), ["requested_url"], retries=4).select("requested_url", "body", "http_status", "error")


@query("integrity_missing_rows", f"with {TARGETS}, {COUNTIES} select county, page_type from targets where url = ''")
def missing_rows(spark, d):
    """Against the targets that have a URL, the gaps are missing."""
    return Q.missing_rows(counties(spark, d), M.captured(targets(spark, d)))


@query("integrity_unknown_rows", f"with {TARGETS} select county, page_type from targets where batch = '1'")
def unknown_rows(spark, d):
    return Q.unknown_rows(counties(spark, d).filter("batch <> '1'"), targets(spark, d)).select("county", "page_type")


@query("integrity_batch_mismatch", f"with {TARGETS} select county, page_type, batch from targets where batch = '2'")
def batch_mismatch(spark, d):
    """Against a seed whose second batch is labelled as the third."""
    c = counties(spark, d).withColumn("batch", F.when(F.col("batch") == "2", "3").otherwise(F.col("batch")))
    return Q.batch_mismatch(c, targets(spark, d)).select("county", "page_type", "batch")


@query("integrity_silent_gaps", f"with {TARGETS} select county, page_type from targets where url = '' and notes like '%none for%'")
def silent_gaps(spark, d):
    t = targets(spark, d).withColumn("notes", F.when(F.contains("notes", F.lit("none for")), "?").otherwise(F.col("notes")))
    return Q.silent_gaps(t).select("county", "page_type")


@query("integrity_seed", f"with {COUNTIES} select county, 'seat' as missing from counties where trim(seat) = '' union all select county, 'batch' from counties where batch not in ('1', '2')")
def seed_checks(spark, d):
    c = counties(spark, d)
    return Q.without_seat(c).select("county", F.lit("seat").alias("missing")).unionByName(Q.bad_batches(c, ["1", "2"]).select("county", F.lit("batch").alias("missing")))


@query("integrity_artifacts", f"with {TARGETS} select replace(lower(county), ' ', '_') as slug, page_type, 'page.txt' as name from targets where url <> '' and o = 2")
def artifacts(spark, d):
    """Polling pages lack their text."""
    t = targets(spark, d)
    files = M.captured(t).select(slug(F.col("county")).alias("slug"), "page_type", F.explode(F.when(F.col("page_type") == "polling", F.array(F.lit("page.html"), F.lit("meta.json"))).otherwise(F.array(F.lit("page.html"), F.lit("page.txt"), F.lit("meta.json")))).alias("name"))
    return Q.missing_artifacts(t, files)



@query("plain_or_rendered", """with d as (select doc_id, text, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 500 as shell, doc_id % 3 <> 0 as rendered_ok from documents)
    select doc_id, case when shell and rendered_ok then 'headless' else 'plain' end as render_mode, case when shell and rendered_ok then null when shell then 'render timeout' end as error from d""")
def plain_or_rendered(spark, d):
    """Short documents need rendering; of three renderings one fails."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    common = {"ok": F.lit(True), "html": F.col("text"), "final_url": F.lit("u"), "redirect_chain": F.array(F.lit("u")), "http_status": F.lit(200), "content_type": F.lit("text/html"), "error": F.lit(None).cast("string")}
    plain = docs.select("doc_id", *[c.alias(k) for k, c in common.items()], F.col("text").alias("clean_text"), F.col("text").alias("clean_html"))
    good = F.col("doc_id") % 3 != 0
    rendered = docs.select("doc_id", *[c.alias(k) for k, c in (common | {"ok": good, "error": F.when(~good, "render timeout")}).items()])
    return C.plain_or_rendered(plain, rendered, ["doc_id"]).select("doc_id", "render_mode", "error")


@query("page_liveness", f"with {ATTEMPTS} select requested_url, o, case when http_status is null and not ok then 'broken' when requested_url % 9 = 0 then 'broken' when http_status >= 400 then 'broken' else 'ok' end as verify_status, case when not ok then 'fetch failed: ' || error when requested_url % 9 = 0 then 'non-HTML content (application/pdf) — out of scope' when http_status >= 400 then 'HTTP ' || http_status end as reason from attempts")
def page_liveness(spark, d):
    from ..functions.rules import liveness

    a = attempts(spark, d)
    kind = F.when(F.col("requested_url") % 9 == 0, "application/pdf").otherwise("text/html")
    told = liveness(F.col("requested_url").cast("string"), F.col("ok"), F.col("error"), kind, F.col("http_status"))
    o = F.when(F.col("http2"), F.col("attempt")).otherwise(F.col("attempt") + 1000).cast("long")
    return a.select("requested_url", o.alias("o"), told["status"].alias("verify_status"), told["reason"].alias("reason"))


@query("integrity_gap_artifacts", f"with {TARGETS} select replace(lower(county), ' ', '_') as slug, page_type from targets where url = '' and batch = '1'")
def gap_artifacts(spark, d):
    t = targets(spark, d)
    files = t.filter("batch = '1'").select(slug(F.col("county")).alias("slug"), "page_type")
    return Q.artifacts_of_gaps(t, files)


@query("integrity_values", f"with {TARGETS} select county, page_type from targets where url <> '' and batch = '3'")
def bad_values(spark, d):
    """The third batch's URLs lack their scheme."""
    t = targets(spark, d).withColumn("url", F.when(F.col("batch") == "3", F.regexp_replace("url", "^https://", "")).otherwise(F.col("url")))
    return Q.bad_values(t).select("county", "page_type")


@query("integrity_repeats", f"with {TARGETS} select county, 2 * count(*) as n from targets where url <> '' group by 1")
def repeats(spark, d):
    t = M.captured(targets(spark, d)).select("county")
    return Q.repeated(t.unionByName(t), "county")


@query("fallback_pages", f"with {TARGETS} select county, page_type, case when k % 5 = 0 then '' when url <> '' then url when page_type in ('polling', 'early_voting') then 'hub' else '' end as url, case when k % 5 = 0 then 'GAP: no county-specific page found' when url = '' and page_type not in ('polling', 'early_voting') then 'GAP: no distinct page found (likely folded into elections page)' else '' end as notes from (select t.*, case when url <> '' and batch = '2' then 0 else 1 end as k from targets t)")
def fallbacks(spark, d):
    """The second batch's picks are not plausible."""
    from ..operators.discovery import with_fallbacks

    t = targets(spark, d)
    picks = t.select("county", "page_type", F.when(F.col("url") != "", F.col("url")).alias("pick_url"), (F.col("batch") != "2").alias("plausible"), F.lit("hub").alias("hub_url"), F.lit("elections").alias("elections_url"))
    return with_fallbacks(picks).select("county", "page_type", "url", "notes")
