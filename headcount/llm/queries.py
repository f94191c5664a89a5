"""The registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from headcount.llm import (
    align,
    ann,
    bpe,
    embeddings,
    html_text,
    minhash,
    mixing,
    pii,
    quality,
    url_filter,
    warc,
    whitening,
    word_bpe,
)

QUERIES = {
    "op1_embeddings": embeddings.op1_embeddings,
    "op2_quality": quality.op2_quality,
    "op3_ann": ann.op3_ann,
    "op4_pii": pii.op4_pii,
    "op5_bpe": bpe.op5_bpe,
    "op6_html": html_text.op6_html,
    "op7_urls": url_filter.op7_urls,
    "op8_minhash": minhash.op8_minhash,
    "op9_mixing": mixing.op9_mixing,
    "op10_warc": warc.op10_warc,
    "op11_alignment": align.op11_alignment,
    "op12_word_bpe": word_bpe.op12_word_bpe,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE: dict[str, str] = {
    "op1_embeddings": embeddings.ORACLE_OP1,
    "op3_ann": ann.ORACLE_OP3,
    "op7_urls": url_filter.ORACLE_OP7,
    "op8_minhash": minhash.ORACLE_OP8,
    "op9_mixing": mixing.ORACLE_OP9,
    "op10_warc": warc.ORACLE_OP10,
}
