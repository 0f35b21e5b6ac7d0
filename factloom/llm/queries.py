"""The queries of the dealt operators, by name, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import alignment, ctw, decontaminate, html, langid, matroska, packing, quality, simhash, substring, topk, toxicity, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring": substring.op1_substring,
        "op2_ctw": ctw.op2_ctw,
        "op3_html": html.op3_html,
        "op4_langid": langid.op4_langid,
        "op5_packing": packing.op5_packing,
        "op6_simhash": simhash.op6_simhash,
        "op7_matroska": matroska.op7_matroska,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_quality": quality.op10_quality,
        "op11_topk": topk.op11_topk,
        "op12_alignment": alignment.op12_alignment,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring": substring.ORACLE_SQL, "op8_decontaminate": decontaminate.ORACLE_SQL, "op11_topk": topk.ORACLE_SQL}
