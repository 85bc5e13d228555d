"""From fetch attempts to one capture for each target."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import error_label, is_html, needs_render
from ..functions.values import byte_size, sha256


def arbitrated(attempts: DataFrame, keys: list[str], retries: int = 2) -> DataFrame:
    """One row for each key: the first attempt with a status under 400; else the last that is kept; else an error row.

    Attempts go over HTTP/2 first, then over 1.1. A 5xx before a protocol's last attempt is not kept. Exceptions
    are rows with ok = false and no status.
    """
    order = F.struct((~F.col("http2")).cast("int"), F.col("attempt"))
    kept = F.col("http_status").isNotNull() & ~((F.col("http_status") >= 500) & (F.col("attempt") < retries))
    good = F.col("http_status") < 400
    rank = F.when(good, 0).when(kept, 1).otherwise(2)
    by = Window.partitionBy(*keys).orderBy(rank, F.when(good, order), order.desc())
    top = attempts.withColumn("_k", F.row_number().over(by)).filter("_k = 1").drop("_k")
    failed = rank == 2
    last_error = F.concat(F.lit("plain_fetch_error: "), F.coalesce("error", F.lit("")))
    return top.withColumns({
        "error": F.when(failed, last_error).otherwise(F.col("error")),
        "ok": F.when(failed, F.lit(False)).otherwise(F.col("ok")),
        "http_status": F.when(failed, F.lit(None).cast("int")).otherwise(F.col("http_status")),
    })


def plain_or_rendered(plain: DataFrame, rendered: DataFrame, keys: list[str]) -> DataFrame:
    """The rendered page where the plain one needs it and rendering went well; else the plain one, with the
    rendering's error if it has none. plain: with clean_text and clean_html."""
    r = rendered.select(*keys, F.struct("ok", "html", "final_url", "redirect_chain", "http_status", "content_type", "error").alias("r"))
    joined = plain.join(r, keys, "left")
    needs = needs_render(F.col("ok"), F.col("content_type"), F.col("clean_text"), F.col("clean_html"), F.col("html"))
    take = F.coalesce(needs & F.col("r.ok"), F.lit(False))
    out = joined.withColumn("render_mode", F.when(take, "headless").otherwise("plain"))
    for c in ("html", "final_url", "redirect_chain", "http_status", "content_type"):
        out = out.withColumn(c, F.when(take, F.col(f"r.{c}")).otherwise(F.col(c)))
    return out.withColumn("error", F.when(take, F.col("r.error")).otherwise(F.coalesce("error", F.when(needs, F.col("r.error"))))).drop("r")


def for_targets(targets: DataFrame, captures: DataFrame) -> DataFrame:
    """Each target with the capture of its URL. A URL that serves several targets is captured and cleaned once."""
    return targets.join(captures, targets["url"] == captures["requested_url"], "left")


def snapshot_fields(pages: DataFrame) -> DataFrame:
    """Hashes, size, title and error of cleaned pages; what is no HTML has empty bodies."""
    html = F.when(is_html(F.col("content_type")), F.col("page_html")).otherwise(F.lit(""))
    text = F.when(is_html(F.col("content_type")), F.col("page_txt")).otherwise(F.lit(""))
    return pages.withColumns({
        "html_sha256": sha256(html), "text_sha256": sha256(text), "byte_size": byte_size(html),
        "error": error_label(F.col("error"), html, F.col("content_type"), F.lit(None).cast("string"), text, html),
    })
