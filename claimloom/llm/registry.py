"""The subpackage's queries and their SQL."""

from claimloom.llm import balltree, bpe, chat, dedup, jaccard, langid, packing, pii, tokens, warc

QUERIES = {
    "op1_chat_format": chat.query,
    "op2_warc": warc.query,
    "op3_exact_dedup": dedup.query,
    "op4_pii": pii.query,
    "op5_packing": packing.query,
    "op6_exact_topk": balltree.query,
    "op7_byte_bpe": bpe.query,
    "op8_token_counts": tokens.query,
    "op9_language_id": langid.query,
    "op10_jaccard_join": jaccard.query,
}
ORACLES = {
    "op1_chat_format": chat.SQL,
    "op2_warc": warc.SQL,
    "op3_exact_dedup": dedup.SQL,
    "op6_exact_topk": balltree.SQL,
}
