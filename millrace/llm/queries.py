"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import alignment, bagminhash, bpe, chat, crf, flac, nearest, pfor, pii, repair, simhash, substrings, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_flac": flac.op1,
    "op2_bagminhash": bagminhash.op2,
    "op3_byte_bpe": bpe.op3,
    "op4_line_crf": crf.op4,
    "op5_warc_revisits": warc.op5,
    "op6_pfor": pfor.op6,
    "op7_chat": chat.op7,
    "op8_simhash": simhash.op8,
    "op9_substrings": substrings.op9,
    "op10_pii": pii.op10,
    "op11_multi_index": nearest.op11,
    "op12_repair": repair.op12,
    "op13_alignment": alignment.op13,
}

#: For the others SQL over whole tables is too slow or cannot express them; tests/llm has a brute-force version of each.
ORACLES: dict[str, str] = {"op5_warc_revisits": warc.OP5_SQL}
