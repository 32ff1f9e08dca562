"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from .language_model import op12_context_mixing_score
from .licenses import op10_license_scan
from .lines import OP5_SQL, op5_line_window_dedup
from .minhash import op8_dart_minhash
from .mixing import op4_min_cost_mix
from .negatives import OP13_SQL, op13_block_negatives
from .packing import op2_bm25_packing
from .phrases import OP11_SQL, op11_pcy_phrases
from .quality import op1_crf_line_quality
from .shards import op3_range_coded_ids
from .urls import OP6_SQL, op6_url_asof_lists
from .vectors import op7_embedding_near_dedup
from .warc import op9_warc_index_first

QUERIES = {
    "op1_crf_line_quality": op1_crf_line_quality,
    "op2_bm25_packing": op2_bm25_packing,
    "op3_range_coded_ids": op3_range_coded_ids,
    "op4_min_cost_mix": op4_min_cost_mix,
    "op5_line_window_dedup": op5_line_window_dedup,
    "op6_url_asof_lists": op6_url_asof_lists,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_dart_minhash": op8_dart_minhash,
    "op9_warc_index_first": op9_warc_index_first,
    "op10_license_scan": op10_license_scan,
    "op11_pcy_phrases": op11_pcy_phrases,
    "op12_context_mixing_score": op12_context_mixing_score,
    "op13_block_negatives": op13_block_negatives,
}
ORACLES: dict[str, str] = {
    "op5_line_window_dedup": OP5_SQL,
    "op6_url_asof_lists": OP6_SQL,
    "op11_pcy_phrases": OP11_SQL,
    "op13_block_negatives": OP13_SQL,
}
