"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factsift.llm import (chat_format, html_rules, lexical_search, license_scan, minhash_paths, packing, pii_feistel,
                          prefix_trie, suffix_decontam, token_store, toxicity, vector_graph, warc_index)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_grammar": toxicity.query,
    "op2_pack_patterns": packing.query,
    "op3_warc_index": warc_index.query,
    "op4_block_rules": html_rules.query,
    "op5_feistel_pii": pii_feistel.query,
    "op6_token_planes": token_store.query,
    "op7_chosen_paths": minhash_paths.query,
    "op8_vector_graph": vector_graph.query,
    "op9_license_bands": license_scan.query,
    "op10_suffix_arrays": suffix_decontam.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_grammar_round_trip": chat_format.query,
    "op13_fp_tree_search": lexical_search.query,
}

ORACLE: dict[str, str] = {
    "op9_license_bands": license_scan.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_grammar_round_trip": chat_format.SQL,
    "op13_fp_tree_search": lexical_search.SQL,
}
