"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import bpe, centroids, compaction, embedding_dedup, exact_dedup, language_id, licences, packing, quality, simhash, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_bpe": bpe.op4_bpe,
    "op5_language_id": language_id.op5_language_id,
    "op6_quality": quality.op6_quality,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_licence_scan": licences.op8_licence_scan,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_simhash": simhash.op10_simhash,
    "op11_compaction": compaction.op11_compaction,
    "op12_centroids": centroids.op12_centroids,
    "op13_toxicity": toxicity.op13_toxicity,
}

SQL = {
    "op1_url_filter": url_filter.SQL,
    "op3_embedding_dedup": embedding_dedup.SQL,
    "op8_licence_scan": licences.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op11_compaction": compaction.SQL,
    "op12_centroids": centroids.SQL,
}
