"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .byte_bpe import op3_byte_level_bpe
from .chat_format import OP10_SQL, op10_chat_formatting
from .decontaminate import op7_benchmark_decontamination
from .jaccard_join import op9_ngram_jaccard_join
from .line_dedup import op2_line_dedup
from .periodic_runs import op11_periodic_runs
from .sanitise import OP13_SQL, op13_pii
from .spelling_variants import op12_spelling_variants
from .substring_dedup import op8_substring_dedup
from .toxicity import op5_toxicity
from .url_filter import OP4_SQL, op4_url_filters
from .vector_graph import op1_embedding_near_dedup
from .warc_audit import OP6_SQL, op6_warc_fixity_audit

QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_byte_level_bpe": op3_byte_level_bpe,
    "op4_url_filters": op4_url_filters,
    "op5_toxicity": op5_toxicity,
    "op6_warc_fixity_audit": op6_warc_fixity_audit,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_pii": op13_pii,
}
SQL = {"op4_url_filters": OP4_SQL, "op6_warc_fixity_audit": OP6_SQL, "op10_chat_formatting": OP10_SQL, "op13_pii": OP13_SQL}
