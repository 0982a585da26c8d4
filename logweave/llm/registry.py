"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from logweave.llm import alignment, decontaminate, licenses, mixing, ngram_join, quality, runs, sharding, substrings, tokens, topk, toxicity, winnowing


def queries() -> dict:
    return {
        "op1_topk": topk.op1_topk,
        "op2_quality": quality.op2_quality,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_ngram_join": ngram_join.op4_ngram_join,
        "op5_tokens": tokens.op5_tokens,
        "op6_mixing": mixing.op6_mixing,
        "op7_sharding": sharding.op7_sharding,
        "op8_licenses": licenses.op8_licenses,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_substrings": substrings.op10_substrings,
        "op11_fingerprints": winnowing.op11_fingerprints,
        "op12_runs": runs.op12_runs,
        "op13_alignment": alignment.op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk": topk.SQL,
        "op4_ngram_join": ngram_join.SQL,
        "op6_mixing": mixing.SQL,
        "op7_sharding": sharding.SQL,
        "op10_substrings": substrings.SQL,
    }
