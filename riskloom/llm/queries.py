"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from . import ann, decontam, html_text, langid, lexical, linededup, merkle, minhash, mixing, pii, quality, toxicity, warc

QUERIES = {
    "op1_ann": ann.op1_ann,
    "op2_decontamination": decontam.op2_decontamination,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_warc": warc.op4_warc,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_pii": pii.op6_pii,
    "op7_mixing": mixing.op7_mixing,
    "op8_html_text": html_text.op8_html_text,
    "op9_minhash": minhash.op9_minhash,
    "op10_langid": langid.op10_langid,
    "op11_merkle": merkle.op11_merkle,
    "op12_quality": quality.op12_quality,
    "op13_lexical": lexical.op13_lexical,
}

SQL = {
    "op1_ann": ann.OP1_SQL,
    "op2_decontamination": decontam.OP2_SQL,
    "op3_line_dedup": linededup.OP3_SQL,
    "op4_warc": warc.OP4_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op9_minhash": minhash.OP9_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op13_lexical": lexical.OP13_SQL,
}
