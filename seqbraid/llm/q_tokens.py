"""Queries of SentencePiece (4), token counts (5), binary token output (6) and packing (13)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seqbraid.llm import packing, prefix_bpe, viterbi, wavelet
from seqbraid.llm.common import documents
from seqbraid.llm.registry import query


@query("op4_sentencepiece")
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return viterbi.encode_documents(documents(spark, sf_dir), model)


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return prefix_bpe.token_counts(documents(spark, sf_dir), tokenizer)


@query("op6_token_output")
def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = wavelet.write_shards(documents(spark, sf_dir), tokenizer)
    return wavelet.read_documents(spark, path)


@query("op13_packing")
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.packed(spark, packing.write_sequences(documents(spark, sf_dir), tokenizer))
