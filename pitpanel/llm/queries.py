"""The queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from . import centroids, exact_dedup, merkle, mixing, ngram_join, pii, quality, secret_scan, sentence_piece, sharding, substring_dedup, token_count, toxicity

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_token_counts": token_count.op3_token_counts,
    "op4_sharding": sharding.op4_sharding,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_mixing": mixing.op6_mixing,
    "op7_sentence_piece": sentence_piece.op7_sentence_piece,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_pii": pii.op10_pii,
    "op11_centroid_clusters": centroids.op11_centroid_clusters,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_secret_scan": secret_scan.op13_secret_scan,
}

ORACLE_SQL = {
    "op1_quality_rules": quality.ORACLE_OP1,
    "op2_ngram_join": ngram_join.ORACLE_OP2,
    "op6_mixing": mixing.ORACLE_OP6,
    "op8_exact_dedup": exact_dedup.ORACLE_OP8,
    "op11_centroid_clusters": centroids.ORACLE_OP11,
    "op12_merkle_manifest": merkle.ORACLE_OP12,
    "op13_secret_scan": secret_scan.ORACLE_OP13,
}
