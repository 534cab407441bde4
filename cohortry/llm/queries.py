"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from cohortry.llm import (
    chat, decontamination, language, licenses, minhash, mixing, quality, retrieval, secrets, sharding, simhash, spelling, toxicity,
)

QUERIES = {
    f.__name__: f
    for f in (
        chat.op1_preference_pairs,
        sharding.op2_feistel_shards,
        licenses.op3_rare_token_licenses,
        language.op4_byte_network,
        mixing.op7_hypergeometric_mix,
        toxicity.op5_lexicon_toxicity,
        decontamination.op6_prefix_join,
        quality.op8_host_rules,
        minhash.op9_circulant_minhash,
        secrets.op10_keyword_secrets,
        simhash.op11_deletion_simhash,
        retrieval.op12_dual_tree,
        spelling.op13_trie_frontier,
    )
}
ORACLE_SQL = {
    "op1_preference_pairs": chat.ORACLE_SQL,
    "op2_feistel_shards": sharding.ORACLE_SQL,
    "op3_rare_token_licenses": licenses.ORACLE_SQL,
    "op6_prefix_join": decontamination.ORACLE_SQL,
    "op8_host_rules": quality.ORACLE_SQL,
    "op9_circulant_minhash": minhash.ORACLE_SQL,
    "op10_keyword_secrets": secrets.ORACLE_SQL,
    "op11_deletion_simhash": simhash.ORACLE_SQL,
    "op12_dual_tree": retrieval.ORACLE_SQL,
    "op13_trie_frontier": spelling.ORACLE_SQL,
}
