"""The queries of the training-data operators and, where SQL expresses them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sottovoce.llm import bpe, decontaminate, exact_dedup, fim, language, licenses, near_dedup, quality, rules, sharding, toxicity, trie, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontaminate.op1_decontamination,
        "op2_licenses": licenses.op2_licenses,
        "op3_bpe": bpe.op3_bpe,
        "op4_warc": warc.op4_warc,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_language": language.op6_language,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_sharding": sharding.op8_sharding,
        "op9_near_dedup": near_dedup.op9_near_dedup,
        "op10_quality": quality.op10_quality,
        "op11_fim": fim.op11_fim,
        "op12_quality_rules": rules.op12_quality_rules,
        "op13_prefix_trie": trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontaminate.op1_sql(), "op4_warc": warc.op4_sql(), "op7_exact_dedup": exact_dedup.op7_sql(), "op11_fim": fim.op11_sql(), "op12_quality_rules": rules.op12_sql(), "op13_prefix_trie": trie.op13_sql()}
