"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, langid, neardup, oracles, packing, pieces, pii, quality, secrets, sharding, topk

QUERIES = {
    "op1_odd_sketch": neardup.op1_odd_sketch,
    "op9_string_kernel": langid.op9_string_kernel,
    "op10_markov_secrets": secrets.op10_markov_secrets,
    "op2_line_first": quality.op2_line_first,
    "op3_boosted_pii": pii.op3_boosted_pii,
    "op4_distinct_chunks": pieces.op4_distinct_chunks,
    "op5_no_random_access": topk.op5_no_random_access,
    "op6_min_slack": packing.op6_min_slack,
    "op7_virtual_slots": sharding.op7_virtual_slots,
    "op8_chat_format": chat.op8_chat_format,
}

ORACLE_SQL = {
    "op1_odd_sketch": oracles.OP1,
    "op2_line_first": oracles.OP2,
    "op5_no_random_access": oracles.OP5,
    "op8_chat_format": oracles.OP8,
}
