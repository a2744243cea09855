"""The subpackage's queries and their SQL, for the repository's entry module."""

from __future__ import annotations

import corpus_pipeline
from codeweave.llm import caps, chat, ctw, leaks, lines, mixing, neardup, tiers, tokens, toxicity, urls, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_score": ctw.op3_score,
    "op4_leaks": leaks.op4_leaks,
    "op5_tokens": tokens.op5_tokens,
    "op6_chat": chat.op6_chat,
    "op7_lines": lines.op7_lines,
    "op8_mixing": mixing.op8_mixing,
    "op9_neardup": neardup.op9_neardup,
    "op10_caps": caps.op10_caps,
    "op11_search": tiers.op11_search,
    "op12_urls": urls.op12_urls,
    "pipeline": corpus_pipeline.run,
}
SQL = {"op1_warc": warc.OP1_SQL, "op6_chat": chat.OP6_SQL, "op10_caps": caps.OP10_SQL, "op11_search": tiers.OP11_SQL}
