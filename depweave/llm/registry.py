"""The queries of this subpackage and the SQL that DuckDB can check them with."""

from __future__ import annotations

from depweave.llm import byte_bpe, exact_topk, language_id, lattice_dedup, simhash, source_mixing, substring_dedup, token_counts, tool_calls, url_filter

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_url_filter": url_filter.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_language_id": language_id.query,
    "op5_tool_calls": tool_calls.query,
    "op6_exact_topk": exact_topk.query,
    "op7_lattice_dedup": lattice_dedup.query,
    "op8_byte_bpe": byte_bpe.query,
    "op9_source_mixing": source_mixing.query,
    "op10_simhash": simhash.query,
}
ORACLES: dict[str, str] = {
    "op2_url_filter": url_filter.SQL,
    "op3_substring_dedup": substring_dedup.SQL,
    "op5_tool_calls": tool_calls.SQL,
    "op6_exact_topk": exact_topk.SQL,
    "op7_lattice_dedup": lattice_dedup.SQL,
    "op9_source_mixing": source_mixing.SQL,
}
