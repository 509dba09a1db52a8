"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_formatting import OP4_SQL, op4_chat_formatting
from .decontamination import op9_decontamination
from .importance_resampling import OP12_SQL, op12_importance_resampling
from .lexical_search import OP11_SQL, op11_lexical_search
from .minhash_dedup import op5_minhash_dedup
from .ngram_lm import op3_lm_scoring
from .packing import op8_packing
from .quality_rules import OP2_SQL, op2_quality_rules
from .simhash_dedup import op13_simhash_dedup
from .substring_dedup import OP10_SQL, op10_substring_dedup
from .suffix_dedup import op7_suffix_dedup
from .token_output import op1_token_output
from .toxicity import op6_toxicity

OPERATORS = (
    op1_token_output,
    op2_quality_rules,
    op3_lm_scoring,
    op4_chat_formatting,
    op5_minhash_dedup,
    op6_toxicity,
    op7_suffix_dedup,
    op8_packing,
    op9_decontamination,
    op10_substring_dedup,
    op11_lexical_search,
    op12_importance_resampling,
    op13_simhash_dedup,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL, "op4_chat_formatting": OP4_SQL, "op10_substring_dedup": OP10_SQL, "op11_lexical_search": OP11_SQL, "op12_importance_resampling": OP12_SQL}
