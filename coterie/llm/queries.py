"""The corpus operators' queries and the SQL that some of them can be compared with."""

from coterie.llm import centroids, chat, decontaminate, exact_dedup, fim, language_id, line_dedup, lm_score, mixing, near_dedup, repeats, surrogates, top_k

QUERIES = {
    "op1_near_dedup": near_dedup.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_line_dedup": line_dedup.query,
    "op4_surrogates": surrogates.query,
    "op5_language_id": language_id.query,
    "op6_mixing": mixing.query,
    "op7_decontaminate": decontaminate.query,
    "op8_chat": chat.query,
    "op9_lm_score": lm_score.query,
    "op10_repeats": repeats.query,
    "op11_centroids": centroids.query,
    "op12_fill_in_middle": fim.query,
    "op13_top_k": top_k.query,
}

ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op8_chat": chat.ORACLE,
    "op11_centroids": centroids.ORACLE,
    "op12_fill_in_middle": fim.ORACLE,
    "op13_top_k": top_k.ORACLE,
}
