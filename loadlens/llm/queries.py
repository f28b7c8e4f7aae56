"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from loadlens.llm import decontaminate, exact_dedup, filter_audit, html_extract, langid, licenses, mixing, periodic, secrets, simhash, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_simhash": simhash.op2_simhash,
    "op3_html": html_extract.op3_html,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_langid": langid.op8_langid,
    "op9_warc": warc.op9_warc,
    "op10_secrets": secrets.op10_secrets,
    "op11_licenses": licenses.op11_licenses,
    "op12_periodic": periodic.op12_periodic,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op9_warc": warc.OP9_SQL,
    "op11_licenses": licenses.OP11_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
