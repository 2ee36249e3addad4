"""The queries of this subpackage for __spark_entry__.py, and the SQL of those that SQL can express."""

from __future__ import annotations

from loomwork.llm import chat_formatting, exact_top_k, line_dedup, quality_rules
from loomwork.llm.best_fit_packing import op10_best_fit_packing
from loomwork.llm.near_duplicates import op8_near_duplicates
from loomwork.llm.secret_scan import op3_secret_scan
from loomwork.llm.source_mixing import op6_source_mixing
from loomwork.llm.token_counts import op1_token_counts
from loomwork.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_toxicity": op4_toxicity,
    "op5_chat_formatting": chat_formatting.op5_chat_formatting,
    "op6_source_mixing": op6_source_mixing,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_exact_top_k": exact_top_k.op9_exact_top_k,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE_SQL,
    "op5_chat_formatting": chat_formatting.ORACLE_SQL,
    "op7_quality_rules": quality_rules.ORACLE_SQL,
    "op9_exact_top_k": exact_top_k.ORACLE_SQL,
}
