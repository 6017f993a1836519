"""Queries of the training-data operators and the SQL that checks them."""

from tidewell.llm import conversation_repair, fingerprints, ngram_join, packing, quality_classifier, quality_rules, source_audit, source_mixing, suffix_dedup, token_counts, token_files, topk_search, url_filters

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op1_class_links": ngram_join.op1_class_links,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_url_filters": url_filters.op3_url_filters,
    "op3_junk_urls": url_filters.op3_junk_urls,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_token_files": token_files.op5_token_files,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_packing": packing.op7_packing,
    "op8_topk_search": topk_search.op8_topk_search,
    "op9_source_mixing": source_mixing.op9_source_mixing,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_source_audit": source_audit.op11_source_audit,
    "op12_fingerprints": fingerprints.op12_fingerprints,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}
ORACLES = {
    "op3_url_filters": url_filters.ORACLE,
    "op3_junk_urls": url_filters.JUNK_ORACLE,
    "op4_quality_rules": quality_rules.ORACLE,
    "op8_topk_search": topk_search.ORACLE,
    "op11_source_audit": source_audit.ORACLE,
}
