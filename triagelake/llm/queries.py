"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, bpe, cascade, langid, mixing, quality, sharding, shingles, tokencount, topk, toxicity, vectors, whitening

QUERIES = {
    "op1_exact_top_k": topk.query,
    "op2_bpe": bpe.query,
    "op3_language_id": langid.query,
    "op4_token_counts": tokencount.query,
    "op5_source_mixing": mixing.query,
    "op6_embedding_near_dedup": vectors.query,
    "op7_hilbert_sharding": sharding.query,
    "op8_toxicity": toxicity.query,
    "op9_quality": quality.query,
    "op10_ngram_jaccard_join": shingles.query,
    "op11_token_alignment": alignment.query,
    "op12_quality_rules": cascade.query,
    "op13_embedding_whitening": whitening.query,
}

SQL = {
    "op1_exact_top_k": topk.SQL,
    "op5_source_mixing": mixing.SQL,
    "op6_embedding_near_dedup": vectors.SQL,
    "op12_quality_rules": cascade.SQL,
}
