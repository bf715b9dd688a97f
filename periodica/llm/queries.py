"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from periodica.llm.ann import op4_ann
from periodica.llm.langid import op1_language_id
from periodica.llm.line_dedup import LINE_DEDUP_SQL, op5_line_dedup
from periodica.llm.mixing import op10_mixing
from periodica.llm.packing import op6_best_fit_packing
from periodica.llm.pii import op2_pii
from periodica.llm.quality import op11_quality
from periodica.llm.ranked import RANKED_SQL, op12_ranked_search
from periodica.llm.simhash import op7_simhash
from periodica.llm.substrings import op8_substrings
from periodica.llm.topk import TOP_K_SQL, op9_exact_top_k
from periodica.llm.vector_codes import VECTOR_CODES_SQL, op13_vector_codes
from periodica.llm.warc import WARC_SQL, op3_warc

QUERIES = {f.__name__: f for f in (op1_language_id, op2_pii, op3_warc, op4_ann, op5_line_dedup, op6_best_fit_packing, op7_simhash, op8_substrings, op9_exact_top_k, op10_mixing, op11_quality, op12_ranked_search, op13_vector_codes)}

ORACLES = {"op3_warc": WARC_SQL, "op5_line_dedup": LINE_DEDUP_SQL, "op9_exact_top_k": TOP_K_SQL, "op12_ranked_search": RANKED_SQL, "op13_vector_codes": VECTOR_CODES_SQL}
