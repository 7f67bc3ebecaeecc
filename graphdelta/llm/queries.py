"""Queries of the training-data operators, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphdelta.llm.byte_bpe import op8_byte_bpe
from graphdelta.llm.chat_format import op10_chat_format
from graphdelta.llm.minhash import OP5_SQL, op5_minhash
from graphdelta.llm.packing import op2_packing
from graphdelta.llm.quality import op9_quality
from graphdelta.llm.range_join import OP7_SQL, op7_range_join
from graphdelta.llm.secrets import op4_secrets
from graphdelta.llm.token_files import op6_token_files
from graphdelta.llm.toxicity import op3_toxicity
from graphdelta.llm.url_filter import OP1_SQL, op1_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_packing": op2_packing,
        "op3_toxicity": op3_toxicity,
        "op4_secrets": op4_secrets,
        "op5_minhash": op5_minhash,
        "op6_token_files": op6_token_files,
        "op7_range_join": op7_range_join,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_quality": op9_quality,
        "op10_chat_format": op10_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": OP1_SQL,
        "op5_minhash": OP5_SQL,
        "op7_range_join": OP7_SQL,
    }
