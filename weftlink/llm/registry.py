"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .chroma import chroma_matches, op5_chroma
from .gray_simhash import GROUPS_SQL, code_groups, op4_simhash
from .html_wrapper import op10_html_extraction
from .merge_dropout import DECODED_SQL, decoded_turns, op7_sentencepiece
from .packing import op9_packing
from .quality_forest import COUNTS_SQL, op8_quality_rules, quality_counts
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .toxicity import op2_toxicity
from .url_filter import RULES_SQL, op6_url_filter, url_rules
from .warc_bundles import OP3_SQL, op3_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_simhash": op4_simhash,
    "op5_chroma": op5_chroma,
    "op6_url_filter": op6_url_filter,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_html_extraction": op10_html_extraction,
    "chroma_matches": chroma_matches,
    # parts of the above that SQL can state
    "code_groups": code_groups,
    "url_rules": url_rules,
    "decoded_turns": decoded_turns,
    "quality_counts": quality_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op3_warc": OP3_SQL,
    "code_groups": GROUPS_SQL,
    "url_rules": RULES_SQL,
    "decoded_turns": DECODED_SQL,
    "quality_counts": COUNTS_SQL,
}
