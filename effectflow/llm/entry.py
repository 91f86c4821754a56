"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from effectflow.llm import chat, decontaminate, filteraudit, fingerprint, media, mixing, packing, pii, quality, simjoin, tokencount, urlfilter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_importance_resampling": quality.op1_importance_resampling,
        "op2_source_mix": mixing.op2_source_mix,
        "op3_fingerprints": fingerprint.op3_fingerprints,
        "op4_separator_scan": tokencount.op4_separator_scan,
        "op5_url_filter": urlfilter.op5_url_filter,
        "op6_jaccard_join": simjoin.op6_jaccard_join,
        "op7_packing": packing.op7_packing,
        "op8_prefix_targets": chat.op8_prefix_targets,
        "op9_personal_data": pii.op9_personal_data,
        "op10_media_columns": media.op10_media_columns,
        "op11_decontamination": decontaminate.op11_decontamination,
        "op12_filter_audit": filteraudit.op12_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    """Text operators whose results SQL can express; op6's compares all pairs and suits small tables only."""
    return {
        "op5_url_filter": urlfilter.SQL, "op6_jaccard_join": simjoin.SQL, "op8_prefix_targets": chat.SQL,
        "op11_decontamination": decontaminate.SQL, "op12_filter_audit": filteraudit.SQL,
    }
