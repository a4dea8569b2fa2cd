"""The queries of this folder's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .ann import op9_nearest_neighbours
from .html_text import op4_html_extraction
from .jaccard import op6_ngram_jaccard_join
from .language import op5_language_id
from .licenses import op8_license_scan
from .mixing import op7_source_mix
from .packing import op1_best_fit_packing
from .quality import op2_quality_rules
from .token_files import op3_token_counts
from .toxicity import op10_toxicity

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_counts": op3_token_counts,
    "op4_html_extraction": op4_html_extraction,
    "op5_language_id": op5_language_id,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_source_mix": op7_source_mix,
    "op8_license_scan": op8_license_scan,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {}
