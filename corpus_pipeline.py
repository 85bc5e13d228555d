"""A corpus pipeline of five stages: language, near duplicates, repeated passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before has kept. Until the last, docs
keeps the columns of documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetide.llm.bpe import tokenizer_path
from pagetide.llm.common import documents, stored
from pagetide.llm.langid import UNDETERMINED, identified
from pagetide.llm.neardup import near_duplicates
from pagetide.llm.packing import packed
from pagetide.llm.pii import masked, personal_spans
from pagetide.llm.repeats import PASSAGES, repeated_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without text or letters go. lang becomes the prediction."""
    return identified(docs.select(*COLUMNS)).filter(F.col("lang_pred") != UNDETERMINED).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id. Of rows that repeat a doc_id
    one stays, the first by its columns; rows without doc_id all stay."""
    docs = docs.select(*COLUMNS)
    kept = near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    first = Window.partitionBy("doc_id").orderBy("text", "lang", "source", "n_chars")
    one = docs.join(kept, "doc_id", "left_semi").withColumn("_k", F.row_number().over(first)).filter("_k = 1").select(*COLUMNS)
    return one.unionByName(docs.filter("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words that repeat; documents of which no word is left go."""
    left = repeated_spans(docs, with_text=True, carry=("lang", "source"), unit=PASSAGES).withColumnRenamed("kept_text", "text")
    return left.withColumn("n_chars", F.length("text").cast("long")).filter(F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with [KIND] in place of personal data; where spans overlap, the first takes the place."""
    found = personal_spans(docs, carry=("text", "lang", "source"))
    return found.withColumn("text", F.expr(masked())).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return packed(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicate), ("repeated_passages", repeated_passages), ("personal_data", personal_data), ("packing", packing)]

#: Kernels, sketches and estimated models are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = documents(spark, sf_dir, *COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))  # the next stage depends on these files alone
    return STAGES[-1][1](spark, docs, sf_dir)
