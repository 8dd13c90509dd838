"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from barloom.llm.alignment import op12_token_alignment
from barloom.llm.decontam import OP4_SQL, op4_winnowing
from barloom.llm.jaccard import op8_vertical_jaccard
from barloom.llm.langid import op9_language_codes
from barloom.llm.mixing import op3_context_mixing
from barloom.llm.negatives import OP11_SQL, op11_hard_negatives
from barloom.llm.packing import op13_histogram_packing
from barloom.llm.pii import op2_private_votes
from barloom.llm.pieces import op7_piece_nbest
from barloom.llm.quality import op5_quality_rules
from barloom.llm.repeats import op6_previous_factors
from barloom.llm.sstable import op10_sstable_shards
from barloom.llm.toxicity import op1_toxic_crf


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxic_crf, op2_private_votes, op3_context_mixing, op4_winnowing, op5_quality_rules, op6_previous_factors, op7_piece_nbest, op8_vertical_jaccard, op9_language_codes, op10_sstable_shards, op11_hard_negatives, op12_token_alignment, op13_histogram_packing)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op4_winnowing": OP4_SQL, "op11_hard_negatives": OP11_SQL}
