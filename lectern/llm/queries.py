"""The registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from lectern.llm import bpe, hnsw, licenses, mil, mixing, quality, ranked, secrets, sharding, simhash, token_counts, warc, whitening


def queries() -> dict:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_warc": warc.op2_warc,
        "op3_sharding": sharding.op3_sharding,
        "op4_secret_scans": secrets.op4_secret_scans,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_simhash": simhash.op6_simhash,
        "op7_bpe": bpe.op7_bpe,
        "op8_mixing": mixing.op8_mixing,
        "op9_quality_classifier": mil.op9_quality_classifier,
        "op10_embedding_near_dedup": hnsw.op10_embedding_near_dedup,
        "op11_embedding_whitening": whitening.op11_embedding_whitening,
        "op12_ranked_search": ranked.op12_ranked_search,
        "op13_license_scans": licenses.op13_license_scans,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.OP1_SQL,
        "op2_warc": warc.OP2_SQL,
        "op3_sharding": sharding.OP3_SQL,
        "op10_embedding_near_dedup": hnsw.OP10_SQL,
        "op12_ranked_search": ranked.OP12_SQL,
    }
