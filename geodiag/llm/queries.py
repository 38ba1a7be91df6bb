"""The operators' queries and SQL."""

from geodiag.llm import chat, embeddings, extraction, interactions, licenses, minhash, mixing, quality, runs, sampling, scoring, substrings, warc

QUERIES = {
    "op1_substring_dedup": substrings.op1_substring_dedup,
    "op2_lm_scoring": scoring.op2_lm_scoring,
    "op3_embedding_dedup": embeddings.op3_embedding_dedup,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_minhash_dedup": minhash.op5_minhash_dedup,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_chat_format": chat.op8_chat_format,
    "op9_sentencepiece": sampling.op9_sentencepiece,
    "op10_warc": warc.op10_warc,
    "op11_runs": runs.op11_runs,
    "op12_html_extraction": extraction.op12_html_extraction,
    "op13_filter_audit": interactions.op13_filter_audit,
}

#: the others have no form in SQL: lattices, chains and sampled pieces; they're tested against brute force
SQL = {
    "op3_embedding_dedup": embeddings.OP3_SQL,
    "op4_quality_rules": quality.OP4_SQL,
    "op5_minhash_dedup": minhash.OP5_SQL,
    "op6_source_mixing": mixing.OP6_SQL,
    "op8_chat_format": chat.OP8_SQL,
    "op10_warc": warc.OP10_SQL,
    "op12_html_extraction": extraction.OP12_SQL,
    "op13_filter_audit": interactions.OP13_SQL,
}
