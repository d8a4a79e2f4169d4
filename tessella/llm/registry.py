"""Queries of this subpackage, and the SQL of those that SQL can express."""

from . import byte_bpe, exact_dedup, html_text, language, order_minhash, packing, product_quantiser, sharding, suffix_dedup, suffix_tree

QUERIES = {
    "op1_order_minhash": order_minhash.op1_order_minhash,
    "op2_language_mixture": language.op2_language_mixture,
    "op3_text_density": html_text.op3_text_density,
    "op4_product_quantisation": product_quantiser.op4_product_quantisation,
    "op5_label_propagation": sharding.op5_label_propagation,
    "op6_sparse_suffixes": suffix_dedup.op6_sparse_suffixes,
    "op7_suffix_tree_score": suffix_tree.op7_suffix_tree_score,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_word_shuffle_bpe": byte_bpe.op9_word_shuffle_bpe,
    "op10_pattern_packing": packing.op10_pattern_packing,
}
SQL = {
    "op8_exact_dedup": exact_dedup.SQL,
}
