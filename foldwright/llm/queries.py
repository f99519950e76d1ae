"""The registered query of every operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foldwright.llm.base import read_table
from foldwright.llm.bpe_codec import bpe_round_trip
from foldwright.llm.decontaminate import contaminated
from foldwright.llm.embedding_cells import EMBEDDINGS_SQL, embedding_groups
from foldwright.llm.line_spread import LINES_SQL, remove_spread_lines
from foldwright.llm.merkle_manifest import MERKLE_SQL, tampered_manifest
from foldwright.llm.packing import pack
from foldwright.llm.quality import quality_scores
from foldwright.llm.secret_ledger import SECRETS_SQL, secret_digest
from foldwright.llm.simhash import simhash_groups
from foldwright.llm.token_alignment import alignment_digest
from foldwright.llm.token_files import token_round_trip
from foldwright.llm.toxicity import toxicity_scores
from foldwright.llm.url_lists import URLS_SQL, filtered_pages

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), TOKENIZER, END_ID)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(read_table(spark, sf_dir, "embeddings"))


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered_pages(spark, sf_dir)


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(read_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_spread_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed_lines")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(read_table(spark, sf_dir, "documents"), TOKENIZER, END_ID)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digest(read_table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampered_manifest(read_table(spark, sf_dir, "documents"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read_table(spark, sf_dir, "documents"), BYTE_BPE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_decontamination": op4_decontamination,
    "op5_embedding_cells": op5_embedding_cells,
    "op6_url_lists": op6_url_lists,
    "op7_secret_ledger": op7_secret_ledger,
    "op8_quality": op8_quality,
    "op9_line_spread": op9_line_spread,
    "op10_token_files": op10_token_files,
    "op11_alignment": op11_alignment,
    "op12_merkle": op12_merkle,
    "op13_bpe": op13_bpe,
}
SQL: dict[str, str] = {
    "op5_embedding_cells": EMBEDDINGS_SQL,
    "op6_url_lists": URLS_SQL,
    "op7_secret_ledger": SECRETS_SQL,
    "op9_line_spread": LINES_SQL,
    "op12_merkle": MERKLE_SQL,
}
