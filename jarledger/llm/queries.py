"""Registered queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from jarledger.llm import chunk_dedup, decontam, license_scan
from jarledger.llm.chunk_dedup import op8_chunk_dedup
from jarledger.llm.decontam import op3_benchmark_decontamination
from jarledger.llm.lang_mixture import op7_language_id
from jarledger.llm.license_scan import op4_license_scan
from jarledger.llm.merkle_manifest import op13_merkle_manifest
from jarledger.llm.minhash_index import op12_minhash_near_dedup
from jarledger.llm.secret_scan import op2_secret_scan
from jarledger.llm.sentencepiece_stream import op1_sentencepiece
from jarledger.llm.simhash_pivot import op9_simhash_near_dedup
from jarledger.llm.suffix_dedup import op5_suffix_dedup
from jarledger.llm.token_alignment import op11_cross_tokenizer
from jarledger.llm.token_output import op6_token_output
from jarledger.llm.toxicity_fst import op10_toxicity

QUERIES = {f.__name__: f for f in (
    op1_sentencepiece, op2_secret_scan, op3_benchmark_decontamination, op4_license_scan, op5_suffix_dedup,
    op6_token_output, op7_language_id, op8_chunk_dedup, op9_simhash_near_dedup, op10_toxicity,
    op11_cross_tokenizer, op12_minhash_near_dedup, op13_merkle_manifest)}
ORACLE_SQL = {
    "op3_benchmark_decontamination": decontam.ORACLE,
    "op4_license_scan": license_scan.oracle(),
    "op8_chunk_dedup": chunk_dedup.ORACLE,
}
