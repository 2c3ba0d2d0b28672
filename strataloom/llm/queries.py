"""Registered queries of the training-data operators."""

from __future__ import annotations

from strataloom.llm.audio import op8_audio_features
from strataloom.llm.bpe import op6_bpe
from strataloom.llm.fingerprint import op5_fingerprints
from strataloom.llm.importance import op12_importance
from strataloom.llm.language_id import op10_language_id
from strataloom.llm.line_dedup import OP1_SQL, op1_line_dedup
from strataloom.llm.minhash import op4_minhash_near_dedup
from strataloom.llm.mixing import op2_mixing, op2_sql
from strataloom.llm.packed_ids import op11_packed_ids
from strataloom.llm.pii import op3_pii_surrogates
from strataloom.llm.quality import op9_quality
from strataloom.llm.ranked_search import op13_ranked_search
from strataloom.llm.warc import OP7_SQL, op7_warc_fixity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_fingerprints": op5_fingerprints,
    "op6_bpe": op6_bpe,
    "op7_warc_fixity": op7_warc_fixity,
    "op8_audio_features": op8_audio_features,
    "op9_quality": op9_quality,
    "op10_language_id": op10_language_id,
    "op11_packed_ids": op11_packed_ids,
    "op12_importance": op12_importance,
    "op13_ranked_search": op13_ranked_search,
}
ORACLES = {"op1_line_dedup": OP1_SQL, "op2_mixing": op2_sql(), "op7_warc_fixity": OP7_SQL}
