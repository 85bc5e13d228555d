"""Quality rules with thresholds from the data.

Each document gets a few ratios of a count to a size, as (count + 1/2) / (size + 1): where nearly all counts are 0, as
those of symbols and repeated lines, such a ratio is still spread by the sizes of documents, so its quantiles say how small a
rate the group's texts can show at all, and no fence is 0. For each language and source, and each ratio, a quantile sketch of logarithmic
buckets (relative error 1 %) is kept as rows (language, source, ratio, bucket, count): sketches merge by adding
counts, so a language's sketch, and that of everything, come from those of its sources without a second pass. The
fences of a group lie beyond its tail quantiles, REACH times as far as these are from the median. A document is dropped
when a count lies outside what its group's fences allow for its size, by more than three standard errors of such a count. No
constant count decides. Sources with too few documents take their language's fences, languages with too few those of everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ODD, WordHashes, documents, mix, stored

#: Ratio -> (count, size, whether low values count as bad too).
RATIOS = {
    "symbols": ("n_symbols", "n_words", False),
    "dup_lines": ("n_dup_lines", "n_lines", False),
    "repeats": ("n_repeat_words", "n_words", False),
    "word_chars": ("word_chars", "n_words", True),
}
#: Growth of the sketch's buckets, documents that make a group, tail quantile, reach beyond it in distances from the median,
#: and how many standard errors a count may lie outside. The same for every ratio.
GAMMA, ENOUGH, TAIL, REACH, ERRORS = 1.02, 200, 0.9, 6.0, 3.0
SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


def repeated_words(h: np.ndarray) -> int:
    """How many words lie in a three-word window that the text has at least twice."""
    if len(h) < 4:
        return 0
    w = mix((h[:-2] * ODD + h[1:-1]) * ODD + h[2:])
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    for at in (order[1:][same], order[:-1][same]):
        for k in range(3):
            twice[at + k] = True
    return int(twice.sum())


def measured(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, source) without text, with the counts of each document; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            rows = []
            for x in b.column(1):
                text = x.as_py() or ""
                raw = text.encode("utf-8", "replace")
                words = raw.split()
                lines = [line for line in raw.split(b"\n") if line.strip()]
                chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
                symbols = len(raw) - len(raw.translate(None, SYMBOLS))
                rows.append((len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(hashes.of(words)), len(lines)))
            cols = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 6)]
            yield pa.record_batch([b.column(0), b.column(2), b.column(3), *cols], [b.schema.names[k] for k in (0, 2, 3)] + NAMES)

    return docs.select("doc_id", "text", "lang", "source").mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in NAMES))


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): one sketch for each language, source and ratio."""
    each = ", ".join(f"'{k}', ({c} + 0.5D) / ({n} + 1)" for k, (c, n, _) in RATIOS.items())
    long = rows.selectExpr("lang", "source", f"stack({len(RATIOS)}, {each}) as (ratio, value)")
    return long.withColumn("bucket", F.ceil(F.log("value") / math.log(GAMMA)).cast("int")).groupBy("lang", "source", "ratio", "bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches of fewer keys: counts add up."""
    return sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, total, <ratio>_low, <ratio>_high) from the sketches' median and tails."""
    by = Window.partitionBy(*keys, "ratio")
    cum = sketch.withColumn("cum", F.sum("n").over(by.orderBy("bucket"))).withColumn("total", F.sum("n").over(by))
    value = F.pow(F.lit(GAMMA), "bucket") * (2 / (1 + GAMMA))
    low, mid, high = (F.min(F.when(F.col("cum") >= p * F.col("total"), value)) for p in (1 - TAIL, 0.5, TAIL))
    quantiles = cum.groupBy(*keys, "ratio").agg(F.max("total").alias("total"), low.alias("low"), mid.alias("mid"), high.alias("high"))
    out = [F.max("total").alias("total")]
    for k, (_, _, both) in RATIOS.items():
        own = F.col("ratio") == k
        out.append(F.max(F.when(own, F.col("high") + REACH * (F.col("high") - F.col("mid")))).alias(f"{k}_high"))
        out.append(F.max(F.when(own, F.greatest(F.lit(0.0), F.col("low") - REACH * (F.col("mid") - F.col("low"))) if both else F.lit(0.0))).alias(f"{k}_low"))
    return quantiles.groupBy(*keys).agg(*out)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row of docs.

    docs(doc_id, text, lang, source, ...). Statistics cover the documents that pass the base rules. A null text has no words, so it fails the base. A null language or
    source is a group like any other. Rows that repeat count as often as they stand there.
    """
    rows = stored(measured(docs).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")))
    own = stored(sketches(rows.filter("not base_failed")))
    by_lang = merged(own, "lang")
    levels = {"s": fences(own, "lang", "source"), "l": fences(by_lang, "lang"), "a": fences(merged(by_lang))}
    names = [f"{k}_{end}" for k in RATIOS for end in ("low", "high")]
    named = {a: t.select(*[F.col(c).alias(f"{a}_{c}") for c in t.columns]) for a, t in levels.items()}
    s, lang, all_ = named["s"], named["l"], named["a"]
    table = s.join(lang, F.col("s_lang").eqNullSafe(F.col("l_lang")), "left").join(F.broadcast(all_), F.lit(True), "left")  # all_: one row
    pick = [F.when(F.col("s_total") >= ENOUGH, F.col(f"s_{c}")).when(F.col("l_total") >= ENOUGH, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}")).alias(c) for c in names]
    table = stored(table.select("s_lang", "s_source", *pick))
    joined = rows.join(table, rows["lang"].eqNullSafe(table["s_lang"]) & rows["source"].eqNullSafe(table["s_source"]), "left")
    inside = F.lit(True)
    for k, (count, n, _) in RATIOS.items():
        low, high = (F.col(f"{k}_{end}") * F.col(n) for end in ("low", "high"))
        inside = inside & F.col(count).between(low - ERRORS * F.sqrt(low), high + ERRORS * F.sqrt(high))
    kept = F.when(F.col("base_failed"), False).otherwise(F.coalesce(inside, F.lit(True)))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over the whole documents table."""
    return judged(documents(spark, sf_dir))
