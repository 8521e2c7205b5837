"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from quern.llm import alignment, chat, decontaminate, jaccard, language, mixing, quality, sharding, spelling, substrings, suffixes, urls, warc

QUERIES = {
    "op1_substrings": substrings.op1_substrings,
    "op2_shard": sharding.op2_shard,
    "op3_language": language.op3_language,
    "op4_urls": urls.op4_urls,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_chat": chat.op6_chat,
    "op7_mix": mixing.op7_mix,
    "op8_suffixes": suffixes.op8_suffixes,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_quality": quality.op10_quality,
    "op11_warc": warc.op11_warc,
    "op12_spelling": spelling.op12_spelling,
    "op13_align": alignment.op13_align,
}

ORACLE_SQL = {
    "op4_urls": urls.OP4_SQL,
    "op5_jaccard": jaccard.OP5_SQL,
    "op6_chat": chat.OP6_SQL,
    "op7_mix": mixing.OP7_SQL,
    "op8_suffixes": suffixes.OP8_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op10_quality": quality.OP10_SQL,
    "op11_warc": warc.OP11_SQL,
    "op12_spelling": spelling.OP12_SQL,
}
