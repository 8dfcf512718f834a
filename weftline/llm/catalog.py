"""The queries of this subpackage, and the SQL of those that SQL can express."""

from . import bpe, kneser_ney, langid, mixing, near_vectors, pii, sharding, simhash, span_dedup, topk


def queries() -> dict:
    return {
        "op1_byte_bpe": bpe.query,
        "op2_minimax_sharding": sharding.query,
        "op3_kneser_ney": kneser_ney.query,
        "op4_vector_range_join": near_vectors.query,
        "op5_sentence_spans": span_dedup.query,
        "op6_ecoc_language_id": langid.query,
        "op7_anchor_pii": pii.query,
        "op8_source_mixing": mixing.query,
        "op9_simhash_index": simhash.query,
        "op10_voronoi_topk": topk.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_vector_range_join": near_vectors.ORACLE, "op8_source_mixing": mixing.ORACLE, "op10_voronoi_topk": topk.ORACLE}
