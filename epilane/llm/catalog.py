"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from epilane.llm import oracles
from epilane.llm.alignment import op11_token_alignment
from epilane.llm.bpe import op9_bpe
from epilane.llm.codes import op13_vector_codes
from epilane.llm.decontaminate import op7_decontaminate
from epilane.llm.neardup import op6_near_dup
from epilane.llm.pii import op4_pii
from epilane.llm.quality import op5_site_quality
from epilane.llm.repeats import op2_suffix_dedup
from epilane.llm.rules import op10_quality_rules
from epilane.llm.setjoin import op12_shingle_join
from epilane.llm.tokenids import op8_token_ids
from epilane.llm.toxicity import op3_toxicity
from epilane.llm.warc import op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_pii": op4_pii,
    "op5_site_quality": op5_site_quality,
    "op6_near_dup": op6_near_dup,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_ids": op8_token_ids,
    "op9_bpe": op9_bpe,
    "op10_quality_rules": op10_quality_rules,
    "op11_token_alignment": op11_token_alignment,
    "op12_shingle_join": op12_shingle_join,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES = {
    "op1_warc": oracles.WARC,
    "op6_near_dup": oracles.NEAR_DUP,
    "op10_quality_rules": oracles.RULES,
    "op12_shingle_join": oracles.SHINGLE_JOIN,
    "op13_vector_codes": oracles.VECTOR_CODES,
}
