"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from symdex.llm import decontamination, embedding_duplicates, hidden_markov, licenses, mixing, near_duplicates, privacy, sharding, toxicity, warc

QUERIES = {
    "op1_rendezvous_sharding": sharding.op1_rendezvous_sharding,
    "op2_benchmark_decontamination": decontamination.op2_benchmark_decontamination,
    "op3_source_mixing": mixing.op3_source_mixing,
    "mix_source_targets": mixing.mix_source_targets,
    "op4_warc_archives": warc.op4_warc_archives,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_pii_sanitisation": privacy.op6_pii_sanitisation,
    "op7_embedding_near_duplicates": embedding_duplicates.op7_embedding_near_duplicates,
    "op8_hidden_markov_scores": hidden_markov.op8_hidden_markov_scores,
    "lm_base_scores": hidden_markov.lm_base_scores,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_minhash_near_duplicates": near_duplicates.op10_minhash_near_duplicates,
}

ORACLES = {
    "op1_rendezvous_sharding": sharding.ORACLE_OP1,
    "op2_benchmark_decontamination": decontamination.ORACLE_OP2,
    "op4_warc_archives": warc.ORACLE_OP4,
    "op5_license_scan": licenses.ORACLE_OP5,
    "lm_base_scores": hidden_markov.ORACLE_BASE,
    "mix_source_targets": mixing.ORACLE_MIX,
}
