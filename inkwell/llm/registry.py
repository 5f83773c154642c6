"""The training-data queries and their SQL, by name."""

from __future__ import annotations

from . import decontamination, html_text, linededup, media, mixing, neardup, packing, quality, resampling, reversed_search, toolcalls, toxicity, urls


def queries() -> dict:
    return {
        "op1_line_dedup": linededup.op1_line_dedup,
        "op2_url_filters": urls.op2_url_filters,
        "op3_html_extraction": html_text.op3_html_extraction,
        "op4_mixing": mixing.op4_mixing,
        "op5_retrieval_packing": packing.op5_retrieval_packing,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_minmax_near_duplicates": neardup.op7_minmax_near_duplicates,
        "op8_media_columns": media.op8_media_columns,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_tool_calls": toolcalls.op10_tool_calls,
        "op11_reversed_search": reversed_search.op11_reversed_search,
        "op12_decontamination": decontamination.op12_decontamination,
        "op13_resampling": resampling.op13_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": linededup.SQL,
        "op2_url_filters": urls.SQL,
        "op4_mixing": mixing.SQL,
        "op10_tool_calls": toolcalls.SQL,
        "op11_reversed_search": reversed_search.SQL,
        "op12_decontamination": decontamination.SQL,
        "op13_resampling": resampling.SQL,
    }
