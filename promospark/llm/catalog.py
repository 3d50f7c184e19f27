"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promospark.llm import oracle
from promospark.llm.bpe_automaton import encode_digests
from promospark.llm.chat import formatted_chats
from promospark.llm.chat_repair import damaged, repair_report
from promospark.llm.common import ensure_checkpoint_dir, read_table, tokenizer_path
from promospark.llm.id_files import read_ids, write_ids
from promospark.llm.language import identify
from promospark.llm.nearest import nearest
from promospark.llm.ngram_join import similarity_components
from promospark.llm.packing import pack
from promospark.llm.quality import quality_report
from promospark.llm.spelling import spelling_variants
from promospark.llm.suffix_dedup import removal_report
from promospark.llm.token_counts import token_counts
from promospark.llm.wrappers import main_text

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(read_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(read_table(spark, sf_dir, "documents"))


def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(read_table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted_chats(read_table(spark, sf_dir, "conversations"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))


def op12_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(read_table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return read_ids(spark, path)


def op13_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = read_table(spark, sf_dir, "conversations")
    return repair_report(damaged(chats), chats)


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_language_id": op3_language_id,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_bpe_automaton": op6_bpe_automaton,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_html_text": op8_html_text,
    "op9_nearest": op9_nearest,
    "op10_ngram_join": op10_ngram_join,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_id_files": op12_id_files,
    "op13_chat_repair": op13_chat_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op7_chat_formatting": oracle.OP7_CHAT_FORMATTING,
    "op5_quality_rules": oracle.OP5_QUALITY_RULES,
}
