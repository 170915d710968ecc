"""The registered queries of the training-data operators, by number."""

from __future__ import annotations

from tracelens.llm import bpe, fingerprint, jaccard, langid, lines, lm, media, packing, suffix, warc

QUERIES = {
    "op1_lines": lines.op1_lines,
    "op2_media": media.op2_media,
    "op3_warc": warc.op3_warc,
    "op4_langid": langid.op4_langid,
    "op5_fingerprint": fingerprint.op5_fingerprint,
    "op6_packing": packing.op6_packing,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_suffix": suffix.op8_suffix,
    "op9_lm": lm.op9_lm,
    "op10_bpe": bpe.op10_bpe,
}
ORACLE_SQL = {"op1_lines": lines.OP1_SQL, "op3_warc": warc.OP3_SQL, "op7_jaccard": jaccard.OP7_SQL, "op8_suffix": suffix.OP8_SQL}
