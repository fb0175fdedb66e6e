"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from volspark.llm import bpe, chat, codes, decontaminate, langid, licenses, minhash, pieces, suffix_dedup, topk, url_filter, warc, whitening

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_pieces": pieces.op2_pieces,
    "op3_warc": warc.op3_warc,
    "op4_near_duplicates": minhash.op4_near_duplicates,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_chat_format": chat.op7_chat_format,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_top_k": topk.op9_top_k,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_bpe": bpe.op11_bpe,
    "op12_whitening": whitening.op12_whitening,
    "op13_vector_codes": codes.op13_vector_codes,
}

ORACLE_SQL = {
    "op3_warc": warc.OP3_SQL,
    "op4_near_duplicates": minhash.OP4_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op6_license_scan": licenses.OP6_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op8_suffix_dedup": suffix_dedup.OP8_SQL,
    "op9_top_k": topk.OP9_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op13_vector_codes": codes.OP13_SQL,
}
