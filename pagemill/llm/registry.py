"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pagemill.llm import decontaminate, embedding_dedup, line_dedup, mixing, quality, secrets, simhash, token_counts, tokens, url_filter

_ALL = {
    "op1_decontaminate": decontaminate,
    "op2_line_dedup": line_dedup,
    "op3_quality": quality,
    "op4_mixing": mixing,
    "op5_secrets": secrets,
    "op6_embedding_dedup": embedding_dedup,
    "op7_token_counts": token_counts,
    "op8_token_output": tokens,
    "op9_url_filter": url_filter,
    "op10_simhash": simhash,
}
QUERIES = {name: module.query for name, module in _ALL.items()}
ORACLES = {name: module.SQL for name, module in _ALL.items() if getattr(module, "SQL", None)}
