"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from isohyet.llm import ann, chat, decontamination, divergence, grace, lm, mixing, quality, repeats, sharding, simhash, toxicity

QUERIES = {
    "op1_importance_resampling": quality.op1_importance_resampling,
    "op2_systematic_mix": mixing.op2_systematic_mix,
    "op3_simhash_windows": decontamination.op3_simhash_windows,
    "op4_suffix_array_family": repeats.op4_suffix_array_family,
    "op5_hnsw_shards": ann.op5_hnsw_shards,
    "op6_katz_backoff": lm.op6_katz_backoff,
    "op7_pigeonring_groups": simhash.op7_pigeonring_groups,
    "op8_budgeted_windows": chat.op8_budgeted_windows,
    "op9_classifier_chain": toxicity.op9_classifier_chain,
    "op10_sampled_splitters": sharding.op10_sampled_splitters,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_grace_dedup": grace.op12_grace_dedup,
}

ORACLE_SQL = {
    "op8_budgeted_windows": chat.OP8_SQL,
    "op2_systematic_mix": mixing.OP2_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
    "op12_grace_dedup": grace.OP12_SQL,
}
