"""Queries of the corpus operators and their DuckDB SQL, by name."""

from __future__ import annotations

from .audio import op1_audio_features
from .language_crf import op7_language_crf
from .mixing import OP6_SQL, op6_raking
from .near_dedup import op5_setsketch
from .packing import op9_pattern_packing
from .quality_model import op4_attention_mil
from .quality_rules import OP10_SQL, op10_quality_rules
from .shards import OP2_SQL, op2_tiered_shards
from .token_blocks import op8_pfor_ids
from .toxicity import op3_toxic_segments

QUERIES = {
    "op1_audio_features": op1_audio_features,
    "op2_tiered_shards": op2_tiered_shards,
    "op3_toxic_segments": op3_toxic_segments,
    "op4_attention_mil": op4_attention_mil,
    "op5_setsketch": op5_setsketch,
    "op6_raking": op6_raking,
    "op7_language_crf": op7_language_crf,
    "op8_pfor_ids": op8_pfor_ids,
    "op9_pattern_packing": op9_pattern_packing,
    "op10_quality_rules": op10_quality_rules,
}

SQL = {
    "op2_tiered_shards": OP2_SQL,
    "op6_raking": OP6_SQL,
    "op10_quality_rules": OP10_SQL,
}
