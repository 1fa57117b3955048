"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from lotwatch.llm import bpe, exact_dedup, mixing, ngram_join, periodic_runs, quality_rules, secrets, sharding, token_store, topk, toxicity, vector_codes, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_topk": topk.query,
    "op3_ngram_join": ngram_join.query,
    "op4_mixing": mixing.query,
    "op5_bpe": bpe.query,
    "op6_toxicity": toxicity.query,
    "op7_token_store": token_store.query,
    "op8_secrets": secrets.query,
    "op9_sharding": sharding.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_periodic_runs": periodic_runs.query,
    "op12_quality_rules": quality_rules.query,
    "op13_vector_codes": vector_codes.query,
}

ORACLES = {
    "op1_warc": warc.ORACLE,
    "op2_topk": topk.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op12_quality_rules": quality_rules.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
