"""The corpus queries and those of their oracles that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm import html_text, langid, linededup, media, mixing, neardup, packing, periodic, pii, quality, ranked, sharding, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        pii.op1_personal_data,
        quality.op2_quality_rules,
        media.op3_media_columns,
        html_text.op4_page_text,
        mixing.op5_mix_documents,
        packing.op6_pack_documents,
        neardup.op7_near_duplicates,
        toxicity.op8_score_toxicity,
        langid.op9_identify_language,
        sharding.op10_shard_documents,
        ranked.op11_ranked_search,
        periodic.op12_periodic_runs,
        linededup.op13_line_dedup,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality.OP2_SQL, "op5_mix_documents": mixing.OP5_SQL, "op11_ranked_search": ranked.OP11_SQL, "op13_line_dedup": linededup.OP13_SQL}
