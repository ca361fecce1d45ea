"""The queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from shoal.llm import licenses, minhash, mixing, neighbours, packing, passages, phrases, pieces, pii, quality, substrings, toxicity, trie

QUERIES = {
    "op1_suffix_dedup": substrings.op1_suffix_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_minhash_near_dedup": minhash.op3_minhash_near_dedup,
    "op4_compact_windows": passages.op4_compact_windows,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_quality_cascade": quality.op6_quality_cascade,
    "op7_pii_pseudonyms": pii.op7_pii_pseudonyms,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_source_mix": mixing.op9_source_mix,
    "op10_additive_neighbours": neighbours.op10_additive_neighbours,
    "op11_conversation_trie": trie.op11_conversation_trie,
    "op12_piece_encoding": pieces.op12_piece_encoding,
    "op13_phrase_collocations": phrases.op13_phrase_collocations,
}
ORACLES = {
    "op6_quality_cascade": quality.SQL,
    "op9_source_mix": mixing.SQL,
    "op11_conversation_trie": trie.SQL,
    "op13_phrase_collocations": phrases.SQL,
}
