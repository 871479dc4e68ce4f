"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from treeq.llm import ann, crosstok, decontam, hardneg, langid, linededup, mixing, quality, simhash, tokenstore, toxicity, urlfilter, warc

QUERIES = {
    "op1_decontamination": decontam.query,
    "op2_nearest_neighbours": ann.query,
    "op3_token_store": tokenstore.query,
    "op4_quality": quality.query,
    "op5_simhash_dedup": simhash.query,
    "op6_language_id": langid.query,
    "op7_url_filter": urlfilter.query,
    "op8_toxicity": toxicity.query,
    "op9_line_dedup": linededup.query,
    "op10_source_mixing": mixing.query,
    "op11_hard_negatives": hardneg.query,
    "op12_cross_tokenizer": crosstok.query,
    "op13_warc": warc.query,
}

ORACLE_SQL = {
    "op1_decontamination": decontam.ORACLE_SQL,
    "op7_url_filter": urlfilter.ORACLE_SQL,
    "op9_line_dedup": linededup.ORACLE_SQL,
    "op10_source_mixing": mixing.ORACLE_SQL,
    "op11_hard_negatives": hardneg.ORACLE_SQL,
    "op13_warc": warc.ORACLE_SQL,
}
