"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from sparkloom.llm import alignment, chat, exact_dedup, jaccard_join, langid, licenses, mixing, pieces, quality_knn, spelling, spotsigs, sstable, url_filter

QUERIES = {
    "op1_quality_knn": quality_knn.op1_quality_knn,
    "op2_sstable": sstable.op2_sstable,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_langid": langid.op4_langid,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_spotsigs": spotsigs.op7_spotsigs,
    "op8_pieces": pieces.op8_pieces,
    "op9_chat": chat.op9_chat,
    "op10_mixing": mixing.op10_mixing,
    "op11_alignment": alignment.op11_alignment,
    "op12_spelling": spelling.op12_spelling,
    "op13_licenses": licenses.op13_licenses,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op5_url_filter": url_filter.SQL,
    "op7_spotsigs": spotsigs.SQL,
    "op9_chat": chat.SQL,
    "op10_mixing": mixing.SQL,
}
