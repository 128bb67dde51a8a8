"""The queries of this package and the SQL of those that SQL can express."""

from . import decontamination, html_text, katz, mixing, near_duplicates, personal_data, quality, resampling, sharding, token_counts, top_k, vector_duplicates, whitening

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality": quality.op3_quality,
    "op4_near_duplicates": near_duplicates.op4_near_duplicates,
    "op5_top_k": top_k.op5_top_k,
    "op6_katz": katz.op6_katz,
    "op7_personal_data": personal_data.op7_personal_data,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_html_text": html_text.op9_html_text,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_vector_duplicates": vector_duplicates.op11_vector_duplicates,
    "op12_whitening": whitening.op12_whitening,
    "op13_resampling": resampling.op13_resampling,
}
ORACLES = {
    "op2_mixing": mixing.OP2_SQL,
    "op5_top_k": top_k.OP5_SQL,
    "op10_decontamination": decontamination.OP10_SQL,
    "op11_vector_duplicates": vector_duplicates.OP11_SQL,
    "op13_resampling": resampling.OP13_SQL,
}
