"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, fingerprint, html, langid, near_dup, pii, repeats, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": repeats.op1_suffix_dedup,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
        "op4_html_extraction": html.op4_html_extraction,
        "op5_order_minhash": near_dup.op5_order_minhash,
        "op6_pii_sanitisation": pii.op6_pii_sanitisation,
        "op7_byte_bpe": bpe.op7_byte_bpe,
        "op8_warc_revisits": warc.op8_warc_revisits,
        "op9_multiset_fingerprint": fingerprint.op9_multiset_fingerprint,
        "op10_language_id": langid.op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_benchmark_decontamination": decontaminate.ORACLE,
        "op8_warc_revisits": warc.ORACLE,
    }
