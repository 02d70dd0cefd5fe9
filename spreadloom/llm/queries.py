"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from spreadloom.llm import chosenpath, hamming, lattice, licenses, mixture, packing, quality, repair, rules, shards, suffixes, tokenfile, treap

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_token_files": tokenfile.op3_token_files,
    "op4_mix_sources": mixture.op4_mix_sources,
    "op5_quality": quality.op5_quality,
    "op6_extendible_shards": shards.op6_extendible_shards,
    "op7_near_vectors": lattice.op7_near_vectors,
    "op8_jaccard_join": chosenpath.op8_jaccard_join,
    "op9_hamming_top_k": hamming.op9_hamming_top_k,
    "op10_pack": packing.op10_pack,
    "op11_quality_rules": rules.op11_quality_rules,
    "op12_ranked_search": treap.op12_ranked_search,
    "op13_conversation_repair": repair.op13_conversation_repair,
}

#: The others depend on hashes or vocabularies that SQL does not have; tests hold them against brute force.
SQL = {"op6_extendible_shards": shards.OP6_SQL, "op11_quality_rules": rules.OP11_SQL, "op12_ranked_search": treap.OP12_SQL}
