"""The numbered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidebook.llm import ann, bpe, covertree, decontamination, fim, phrases, pii, quality, secrets, sharding, simhash, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_secrets": secrets.op2_secrets,
        "op3_decontamination": decontamination.op3_decontamination,
        "op4_quality": quality.op4_quality,
        "op5_pii": pii.op5_pii,
        "op6_embedding_dedup": covertree.op6_embedding_dedup,
        "op7_warc": warc.op7_warc,
        "op8_sharding": sharding.op8_sharding,
        "op9_bpe": bpe.op9_bpe,
        "op10_simhash": simhash.op10_simhash,
        "op11_ann": ann.op11_ann,
        "op12_fim": fim.op12_fim,
        "op13_phrases": phrases.op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secrets": secrets.ORACLE_SQL,
        "op3_decontamination": decontamination.ORACLE_SQL,
        "op6_embedding_dedup": covertree.ORACLE_SQL,
        "op7_warc": warc.ORACLE_SQL,
        "op12_fim": fim.ORACLE_SQL,
        "op13_phrases": phrases.ORACLE_SQL,
    }
