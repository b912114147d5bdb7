"""The registered queries of this subpackage: name → (function, SQL or None)."""

from __future__ import annotations

from reviewlake.llm import bitplanes, bpe, html_text, language, licenses, mtree, neargraph, order_minhash, packing, passages, preference, tokens, whitening

QUERIES = {
    "op1_token_counts": (tokens.op1_token_counts, None),
    "op2_bpe_round_trip": (bpe.op2_bpe_round_trip, None),
    "op3_license_scan": (licenses.op3_license_scan, None),
    "op4_language": (language.op4_language, None),
    "op5_packing": (packing.op5_packing, None),
    "op8_order_minhash": (order_minhash.op8_order_minhash, None),
    "op6_embedding_graph": (neargraph.op6_embedding_graph, neargraph.OP6_SQL),
    "op9_exact_top_k": (mtree.op9_exact_top_k, mtree.OP9_SQL),
    "op7_preference_pairs": (preference.op7_preference_pairs, preference.OP7_SQL),
    "op11_main_text": (html_text.op11_main_text, None),
    "op12_bit_plane_clusters": (bitplanes.op12_bit_plane_clusters, bitplanes.OP12_SQL),
    "op13_whitening": (whitening.op13_whitening, None),
    "op10_passages": (passages.op10_passages, None),
}
