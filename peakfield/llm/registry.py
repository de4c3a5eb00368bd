"""The queries of this package, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: name -> module of the operator's query.
MODULES = {
    "op1_simhash": "simhash",
    "op3_token_counts": "lengths",
    "op6_arrow_ids": "arrowfile",
    "op10_pattern_packing": "packing",
    "op5_curriculum": "curriculum",
    "op7_polynomial_dedup": "exact",
    "op4_label_propagation": "sharding",
    "op2_hidden_markov": "hmm",
    "op8_word_backoff": "langid",
    "op9_spotsigs": "spotsigs",
    "op11_conversation_repair": "conversations",
    "op12_ball_tree": "balltree",
    "op13_annular_codes": "annular",
}


def queries() -> dict:
    return {name: getattr(import_module(f"peakfield.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in MODULES.items():
        sql = getattr(import_module(f"peakfield.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
