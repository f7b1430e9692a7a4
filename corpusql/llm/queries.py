"""Registered queries of the operators and their DuckDB SQL."""

from corpusql.llm import bwtmerge, divergence, filteraudit, fmindex, minhash, mixing, multiset, pieces, quality, simhash, topk, toxicity, warc

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_warc_archives": warc.op2_warc_archives,
    "op3_bwt_merge_dedup": bwtmerge.op3_bwt_merge_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_fm_index_dedup": fmindex.op6_fm_index_dedup,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_topk_search": topk.op8_topk_search,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_document_fingerprints": multiset.op10_document_fingerprints,
    "op11_filter_audit": filteraudit.op11_filter_audit,
    "op12_minhash_near_dedup": minhash.op12_minhash_near_dedup,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLES = {
    "op6_fm_index_dedup": fmindex.ORACLE_SQL,
    "op8_topk_search": topk.ORACLE_SQL,
    "op2_warc_archives": warc.ORACLE_SQL,
    "op5_mix_sources": mixing.ORACLE_SQL,
    "op11_filter_audit": filteraudit.ORACLE_SQL,
    "op12_minhash_near_dedup": minhash.ORACLE_SQL,
    "op13_source_divergence": divergence.ORACLE_SQL,
}
