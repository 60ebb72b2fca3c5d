"""The queries of the training-data operators and the SQL of those that SQL can express."""

from docloom.llm import bpe, chat, exact_dedup, exact_search, fill_in_middle, jaccard_join, language_model, media, packing, suffix_dedup, token_store, toxicity, whitening

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_chat": chat.op5_chat,
    "op6_language_model": language_model.op6_language_model,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_media": media.op9_media,
    "op10_token_store": token_store.op10_token_store,
    "op11_whitening": whitening.op11_whitening,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_exact_search": exact_search.op13_exact_search,
}

SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op4_suffix_dedup": suffix_dedup.OP4_SQL,
    "op5_chat": chat.OP5_SQL,
    "op8_jaccard_join": jaccard_join.OP8_SQL,
    "op12_fill_in_middle": fill_in_middle.OP12_SQL,
    "op13_exact_search": exact_search.OP13_SQL,
}
