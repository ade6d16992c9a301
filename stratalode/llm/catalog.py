"""Queries of the corpus operators, with their oracle SQL where SQL can express them."""

from __future__ import annotations

from .decontaminate import op3_benchmark_decontamination
from .divergence import op11_source_divergence
from .fingerprints import op1_document_fingerprints
from .importance import op8_importance_resampling
from .katz import op4_lm_scoring
from .language import op7_language_id
from .oracles import DECONTAMINATION, DIVERGENCE, REPEATS, URL_FILTERS
from .pieces import op2_sentencepiece
from .private_data import op10_private_data
from .repeats import op6_substring_dedup
from .runs import op12_periodic_runs
from .simhash import op9_simhash_near_dedup
from .token_files import op5_token_files
from .url_filters import op13_url_filters

QUERIES = {
    f.__name__: f
    for f in (
        op1_document_fingerprints, op2_sentencepiece, op3_benchmark_decontamination, op4_lm_scoring, op5_token_files, op6_substring_dedup,
        op7_language_id, op8_importance_resampling, op9_simhash_near_dedup, op10_private_data, op11_source_divergence, op12_periodic_runs,
        op13_url_filters,
    )
}
ORACLES = {"op3_benchmark_decontamination": DECONTAMINATION, "op6_substring_dedup": REPEATS, "op11_source_divergence": DIVERGENCE, "op13_url_filters": URL_FILTERS}
