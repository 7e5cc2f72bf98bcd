"""The queries and SQL that this subpackage adds to __spark_entry__."""

from __future__ import annotations

from newsloom.llm.decontaminate import OP8_SQL, op8_decontaminate
from newsloom.llm.licenses import op4_licenses
from newsloom.llm.lmscore import OP6_SQL, op6_lm_scores
from newsloom.llm.merkle import OP11_SQL, op11_merkle_manifest
from newsloom.llm.minhash import op13_minhash
from newsloom.llm.mixing import OP9_SQL, op9_mix_sources
from newsloom.llm.neighbours import op2_nearest
from newsloom.llm.periodic import op12_periodic_runs
from newsloom.llm.pii import OP7_SQL, op7_pii
from newsloom.llm.simhash import op3_simhash
from newsloom.llm.substrings import op1_substring_dedup
from newsloom.llm.tokenfiles import op10_token_files
from newsloom.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_nearest": op2_nearest,
    "op3_simhash": op3_simhash,
    "op4_licenses": op4_licenses,
    "op5_toxicity": op5_toxicity,
    "op6_lm_scores": op6_lm_scores,
    "op7_pii": op7_pii,
    "op8_decontaminate": op8_decontaminate,
    "op9_mix_sources": op9_mix_sources,
    "op10_token_files": op10_token_files,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_minhash": op13_minhash,
}

ORACLES = {
    "op6_lm_scores": OP6_SQL,
    "op7_pii": OP7_SQL,
    "op8_decontaminate": OP8_SQL,
    "op9_mix_sources": OP9_SQL,
    "op11_merkle_manifest": OP11_SQL,
}
