"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from stitchwork.llm import bpe, exact_dedup, html_text, near_dedup, packing, quality, secrets, substrings, token_output, transducer

QUERIES = {
    "op1_token_output": token_output.op1_token_output,
    "op2_bpe": bpe.op2_bpe,
    "op3_secrets": secrets.op3_secrets,
    "op4_html_text": html_text.op4_html_text,
    "op5_token_counts": transducer.op5_token_counts,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_packing": packing.op7_packing,
    "op8_quality": quality.op8_quality,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_substrings": substrings.op10_substrings,
}

ORACLE_SQL: dict[str, str] = {"op6_exact_dedup": exact_dedup.OP6_SQL}
