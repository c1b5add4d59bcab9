"""The queries of this package and their SQL."""

from __future__ import annotations

from quirework.llm import chat, langid, merkle, mixing, packing, quality, secrets, simhash, vafile, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_chat": chat.op2_chat,
    "op3_simhash": simhash.op3_simhash,
    "op4_secrets": secrets.op4_secrets,
    "op5_warc": warc.op5_warc,
    "op6_quality": quality.op6_quality,
    "op7_langid": langid.op7_langid,
    "op8_topk": vafile.op8_topk,
    "op9_merkle": merkle.op9_merkle,
    "op10_packing": packing.op10_packing,
}

ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op5_warc": warc.OP5_SQL,
    "op8_topk": vafile.OP8_SQL,
}
