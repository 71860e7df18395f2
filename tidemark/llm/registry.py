"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, codes, embeddings, fingerprints, html, lmscore, mixing, neardup, packing, quality, sharding, warc, whitening


def queries() -> dict:
    return {
        "op1_near_duplicates": neardup.op1_near_duplicates,
        "op2_mixing": mixing.op2_mixing,
        "op3_embeddings": embeddings.op3_embeddings,
        "op4_chat": chat.op4_chat,
        "op5_warc": warc.op5_warc,
        "op6_sharding": sharding.op6_sharding,
        "op7_quality": quality.op7_quality,
        "op8_packing": packing.op8_packing,
        "op9_lm_score": lmscore.op9_lm_score,
        "op10_fingerprints": fingerprints.op10_fingerprints,
        "op11_whitening": whitening.op11_whitening,
        "op12_vector_codes": codes.op12_vector_codes,
        "op13_html": html.op13_html,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_near_duplicates": neardup.OP1_SQL, "op2_mixing": mixing.OP2_SQL, "op3_embeddings": embeddings.OP3_SQL, "op4_chat": chat.OP4_SQL, "op5_warc": warc.OP5_SQL, "op6_sharding": sharding.OP6_SQL, "op12_vector_codes": codes.OP12_SQL, "op13_html": html.OP13_SQL}
