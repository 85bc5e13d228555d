"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from .bpe import op3_bpe
from .html import op10_main_text
from .langid import op6_language
from .negatives import OP13_SQL, op13_hard_negatives
from .neardup import OP1_SQL, op1_near_duplicates
from .neighbours import op5_neighbours
from .ngram import op2_ngram_scores
from .packing import op9_packing
from .phrases import OP12_SQL, op12_collocations
from .pieces import op11_pieces
from .pii import op8_personal
from .quality import op7_quality
from .repeats import op4_repeats


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_near_duplicates, op2_ngram_scores, op3_bpe, op4_repeats, op5_neighbours, op6_language, op7_quality, op8_personal, op9_packing, op10_main_text, op11_pieces, op12_collocations, op13_hard_negatives)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}



def oracle_sql() -> dict[str, str]:
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {"op1_near_duplicates": OP1_SQL, "op12_collocations": OP12_SQL, "op13_hard_negatives": OP13_SQL} | pipeline
