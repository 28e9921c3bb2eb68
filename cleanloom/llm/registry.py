"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from cleanloom.llm import editprint, html, langid, licences, lines, middles, mixing, pfp, repair, sentencepieces, simhash, topk, warc

QUERIES = {
    "op1_simhash_near_dedup": simhash.query,
    "op2_warc_archive": warc.query,
    "op3_language_id": langid.query,
    "op4_repeated_strings": pfp.query,
    "op5_sentencepiece": sentencepieces.query,
    "op6_line_dedup": lines.query,
    "op7_source_mixing": mixing.query,
    "op8_edit_fingerprints": editprint.query,
    "op9_exact_top_k": topk.query,
    "op10_html_main_text": html.query,
    "op11_conversation_repair": repair.query,
    "op12_licence_scan": licences.query,
    "op13_fill_in_middle": middles.query,
    "edit_near_documents": editprint.near_query,
}

ORACLES: dict[str, str] = {
    "op2_warc_archive": warc.ORACLE,
    "op7_source_mixing": mixing.ORACLE,
    "op9_exact_top_k": topk.ORACLE,
    "op13_fill_in_middle": middles.ORACLE,
}
