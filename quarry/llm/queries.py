"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from quarry.llm.byte_bpe import op7_byte_bpe
from quarry.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from quarry.llm.fingerprints import op10_fingerprints
from quarry.llm.language_model import op2_lm_scoring
from quarry.llm.near_duplicates import op8_ngram_jaccard
from quarry.llm.packing import op4_best_fit_packing
from quarry.llm.pii import op9_pii
from quarry.llm.quality import op1_quality_classifier
from quarry.llm.token_files import op6_token_files
from quarry.llm.toxicity import op5_toxicity

QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_lm_scoring, op3_exact_dedup, op4_best_fit_packing, op5_toxicity, op6_token_files, op7_byte_bpe, op8_ngram_jaccard, op9_pii, op10_fingerprints)}
SQL = {"op3_exact_dedup": OP3_SQL}
