"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from . import alignment, archive, audit, decontaminate, innerproduct, neardup, passages, personal, pieces, sharding, suffixes, toxicity, urlfilter

QUERIES = {
    "op1_url_filter": urlfilter.query,
    "op2_compact_windows": passages.query,
    "op3_suffix_dedup": suffixes.query,
    "op4_personal_data": personal.query,
    "op5_warc_zip": archive.query,
    "op6_decontamination": decontaminate.query,
    "op7_minhash": neardup.query,
    "op8_sentencepiece": pieces.query,
    "op9_toxicity": toxicity.query,
    "op10_topk": innerproduct.query,
    "op11_sharding": sharding.query,
    "op12_filter_audit": audit.query,
    "op13_alignment": alignment.query,
}

ORACLE_SQL = {
    "op1_url_filter": urlfilter.SQL,
    "op5_warc_zip": archive.SQL,
    "op6_decontamination": decontaminate.SQL,
    "op10_topk": innerproduct.SQL,
    "op11_sharding": sharding.SQL,
    "op12_filter_audit": audit.SQL,
}
