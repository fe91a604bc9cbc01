"""The queries of this folder's operators, by name, and the SQL of those that SQL can express."""

from . import langid, linededup, lm, media, mixing, packing, simhash, topk, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_mixing": mixing.op2,
    "op3_line_dedup": linededup.op3,
    "op4_lm_scoring": lm.op4,
    "op5_warc": warc.op5,
    "op6_language_id": langid.op6,
    "op7_packing": packing.op7,
    "op8_simhash": simhash.op8,
    "op9_media": media.op9,
    "op10_topk": topk.op10,
}

ORACLE_SQL = {"op2_mixing": mixing.SQL, "op5_warc": warc.SQL, "op10_topk": topk.SQL}
