"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import htmltext, linededup, mixing, ngramjoin, packing, quality, repetition, resampling, spelling, substrings, topk, toxicity, winnowing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substrings": substrings.op1_substrings,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_quality": quality.op3_quality,
        "op4_mixing": mixing.op4_mixing,
        "op5_html": htmltext.op5_html,
        "op6_winnowing": winnowing.op6_winnowing,
        "op7_topk": topk.op7_topk,
        "op8_linededup": linededup.op8_linededup,
        "op9_ngramjoin": ngramjoin.op9_ngramjoin,
        "op9_ngramjoin_links": ngramjoin.op9_ngramjoin_links,
        "op10_packing": packing.op10_packing,
        "op11_resampling": resampling.op11_resampling,
        "op12_spelling": spelling.op12_spelling,
        "op13_repetition": repetition.op13_repetition,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substrings": substrings.SQL,
        "op4_mixing": mixing.SQL,
        "op7_topk": topk.SQL,
        "op8_linededup": linededup.SQL,
        "op9_ngramjoin": ngramjoin.SQL,
        "op9_ngramjoin_links": ngramjoin.LINKS_SQL,
        "op11_resampling": resampling.SQL,
        "op12_spelling": spelling.SQL,
        "op13_repetition": repetition.SQL,
    }
