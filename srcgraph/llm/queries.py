"""The operators' queries over whole tables, by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from srcgraph.session import shipped

import corpus_pipeline

from . import dedup, langid, licenses, lm, mixing, near, packing, quality, sharding, vectors

QUERIES = {
    "op1_language_id": langid.op1_langid,
    "op2_quality": quality.op2_quality,
    "op3_best_fit_packing": packing.op3_pack,
    "op4_embedding_near_dedup": vectors.op4_vectors,
    "op5_sharding": sharding.op5_shard,
    "op6_mixing": mixing.op6_mix,
    "op7_license_scan": licenses.op7_licenses,
    "op8_exact_dedup": dedup.op8_dedup,
    "op9_lm_scoring": lm.op9_lm,
    "op10_ngram_jaccard": near.op10_near,
    "pipeline": corpus_pipeline.run,
}
QUERIES = {name: shipped(query) for name, query in QUERIES.items()}
ORACLE_SQL = {
    "op4_embedding_near_dedup": vectors.ORACLE_SQL,
    "op5_sharding": sharding.ORACLE_SQL,
    "op6_mixing": mixing.ORACLE_SQL,
    "op7_license_scan": licenses.ORACLE_SQL,
    "op8_exact_dedup": dedup.ORACLE_SQL,
    "op9_lm_scoring": lm.ORACLE_SQL,
    "op10_ngram_jaccard": near.ORACLE_SQL,
}
