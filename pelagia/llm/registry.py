"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from .decontam import op2_benchmark_decontamination
from .lexical_search import op13_ranked_lexical_search
from .licenses import op7_license_scans
from .line_dedup import op1_line_dedup
from .media import op5_media_columns
from .near_dedup import op10_minhash_near_dedup
from .oracle import ORACLE_SQL
from .packing import op4_best_fit_packing
from .prefix_trie import op11_conversation_prefix_trie
from .quality import op12_quality_classifier
from .substring_dedup import op8_substring_dedup
from .token_output import op3_token_output
from .toxicity import op6_toxicity
from .url_filter import op9_url_filters

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op11_conversation_prefix_trie": op11_conversation_prefix_trie,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_ranked_lexical_search": op13_ranked_lexical_search,
    "op1_line_dedup": op1_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op9_url_filters": op9_url_filters,
    "op8_substring_dedup": op8_substring_dedup,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_token_output": op3_token_output,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_media_columns": op5_media_columns,
    "op7_license_scans": op7_license_scans,
}
