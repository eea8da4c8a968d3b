"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, fingerprints, html, licences, lines, media, mixing, neardup, suffixes, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_neardup": neardup.query,
        "op2_byte_bpe": bpe.query,
        "op3_toxicity": toxicity.query,
        "op4_media_columns": media.query,
        "op5_html_extraction": html.query,
        "op6_mixing_sources": mixing.query,
        "op7_fingerprints": fingerprints.query,
        "op8_suffix_dedup": suffixes.query,
        "op9_line_dedup": lines.query,
        "op10_licence_scan": licences.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing_sources": mixing.SQL, "op9_line_dedup": lines.SQL, "op10_licence_scan": licences.SQL}
