"""Registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from sunlattice.llm import ann, licenses, lines, minhash, packing, pii, quality, runs, sentencepieces, sharding, tries, vectors, warc


def queries() -> dict:
    return {
        "op1_ivfpq_search": ann.op1_ivfpq_search,
        "op2_line_dedup": lines.op2_line_dedup,
        "op3_minhash_neardup": minhash.op3_minhash_neardup,
        "op4_stratified_sharding": sharding.op4_stratified_sharding,
        "op5_warc_revisits": warc.op5_warc_revisits,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_license_scan": licenses.op7_license_scan,
        "op8_pii_sanitisation": pii.op8_pii_sanitisation,
        "op9_bestfit_packing": packing.op9_bestfit_packing,
        "op10_sentencepiece": sentencepieces.op10_sentencepiece,
        "op11_int8_embedding_neardup": vectors.op11_int8_embedding_neardup,
        "op12_periodic_runs": runs.op12_periodic_runs,
        "op13_conversation_trie": tries.op13_conversation_trie,
        "pipeline": corpus_pipeline.pipeline,
    }


def oracle_sql() -> dict:
    return {
        "op3_minhash_neardup": minhash.OP3_SQL,
        "op4_stratified_sharding": sharding.OP4_SQL,
        "op5_warc_revisits": warc.OP5_SQL,
        "op6_quality_rules": quality.OP6_SQL,
        "op7_license_scan": licenses.OP7_SQL,
        "op11_int8_embedding_neardup": vectors.OP11_SQL,
        "op13_conversation_trie": tries.OP13_SQL,
    }
