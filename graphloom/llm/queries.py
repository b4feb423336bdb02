"""The registered queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import secret_scan
from graphloom.llm.chat_format import OP5_SQL, op5_chat_format
from graphloom.llm.common import table
from graphloom.llm.embed_dedup import op6_embedding_near_dedup
from graphloom.llm.exact_dedup import exact_dedup
from graphloom.llm.mixing import op2_mix_sources
from graphloom.llm.packing import op4_pack_power_of_two
from graphloom.llm.quality import op9_cotraining_quality
from graphloom.llm.secret_scan import op10_secret_scan
from graphloom.llm.sharding import op3_feistel_sharding
from graphloom.llm.simhash import simhash_groups
from graphloom.llm.toxicity import op1_toxicity


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_mix_sources": op2_mix_sources,
        "op3_feistel_sharding": op3_feistel_sharding,
        "op4_pack_power_of_two": op4_pack_power_of_two,
        "op5_chat_format": op5_chat_format,
        "op6_embedding_near_dedup": op6_embedding_near_dedup,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_cotraining_quality": op9_cotraining_quality,
        "op10_secret_scan": op10_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_format": OP5_SQL, "op8_exact_dedup": OP8_SQL, "op10_secret_scan": secret_scan.oracle()}
