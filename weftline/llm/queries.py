"""The queries of this subpackage by name, and the SQL of those that SQL expresses."""

from __future__ import annotations

from weftline.llm.byte_bpe import op3_byte_bpe
from weftline.llm.divergence import OP11_SQL, op11_source_divergence
from weftline.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from weftline.llm.jaccard_join import op7_jaccard_join
from weftline.llm.language_id import op6_language_id
from weftline.llm.lattice_score import op1_lattice_score
from weftline.llm.media import op10_media
from weftline.llm.mixing import OP13_SQL, op13_source_mixing
from weftline.llm.packing import op2_packing
from weftline.llm.substring_dedup import op8_substring_dedup
from weftline.llm.suffix_dedup import op9_suffix_dedup
from weftline.llm.url_filter import OP5_SQL, op5_url_filter
from weftline.llm.vector_search import op4_vector_search

QUERIES = {
    "op1_lattice_score": op1_lattice_score,
    "op2_packing": op2_packing,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_vector_search": op4_vector_search,
    "op5_url_filter": op5_url_filter,
    "op6_language_id": op6_language_id,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_media": op10_media,
    "op11_source_divergence": op11_source_divergence,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_source_mixing": op13_source_mixing,
}
SQL = {
    "op5_url_filter": OP5_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_source_mixing": OP13_SQL,
}
