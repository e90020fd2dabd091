"""The corpus operators' queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import chat, contamination, licenses, line_templates, near_dup, neighbours, periodic, pii, quality_pu, repair, rules, substrings, tokens

QUERIES = {f.__name__: f for f in (line_templates.op1_line_dedup, quality_pu.op2_quality, substrings.op3_substrings, tokens.op4_sentencepiece, rules.op5_quality_rules, licenses.op6_license_scan, chat.op7_chat, near_dup.op8_near_duplicates, pii.op9_pii, contamination.op10_decontamination, periodic.op11_periodic_runs, neighbours.op12_nearest_neighbours, repair.op13_conversation_repair)}
ORACLES = {"op5_quality_rules": rules.OP5_SQL, "op6_license_scan": licenses.OP6_SQL}
