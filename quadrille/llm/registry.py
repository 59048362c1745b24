"""Queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from quadrille.llm import ann, chat, decontaminate, linededup, mixing, neardup, quality, toxicity, urls, warc

QUERIES = {
    "op1_spaced_seeds": decontaminate.op1_spaced_seeds,
    "op2_poisson_mixing": mixing.op2_poisson_mixing,
    "op3_factorisation_machine": quality.op3_factorisation_machine,
    "op4_chat_parts": chat.op4_chat_parts,
    "op5_multiprobe_lsh": ann.op5_multiprobe_lsh,
    "op6_url_filter": urls.op6_url_filter,
    "op7_text_cnn": toxicity.op7_text_cnn,
    "op8_zip_warc": warc.op8_zip_warc,
    "op9_bbit_minhash": neardup.op9_bbit_minhash,
    "op10_site_spread": linededup.op10_site_spread,
}
SQL = {"op2_poisson_mixing": mixing.OP2_SQL, "op4_chat_parts": chat.OP4_SQL, "op8_zip_warc": warc.OP8_SQL, "op10_site_spread": linededup.OP10_SQL}
