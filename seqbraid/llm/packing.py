"""Sequences by power-of-two decomposition: no sequence crosses documents, none is padded.

A document of n tokens is cut into pieces whose lengths are the binary digits of n, longest
first, with as many pieces of the longest allowed length as fit. Each piece is a sequence
of its own, so its length is a power of two and needs no padding; batches are drawn from
one length at a time. The pieces of a task are sorted by length, so that readers of one
length (`read_sequences(...).filter("length = 1024")`) skip the row groups of the others.

Packing needs no shuffle: it depends on one document at a time.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbraid.llm.common import map_arrow, text_of
from seqbraid.llm.word_ids import word_ids
from seqbraid.session import shared_dir

SEQUENCE_TOKENS = 4096
END_ID = 2

_FIELDS = ("start", "length", "doc_tokens", "ids")
_TYPES = ("long", "long", "long", "binary")


def binary_lengths(tokens: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece lengths of every document, longest first, and the number of pieces of each.

    `longest` must be a power of two; a document of no tokens has no piece.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    powers = longest >> np.arange(longest.bit_length())
    copies = np.empty((len(tokens), len(powers)), np.int64)
    copies[:, 0] = tokens // longest
    copies[:, 1:] = (tokens[:, None] & powers[None, 1:]) > 0
    return np.repeat(np.tile(powers, len(tokens)), copies.ravel()), copies.sum(axis=1)


def pieces(ids: np.ndarray, tokens: np.ndarray, longest: int) -> dict[str, np.ndarray]:
    """row, start, length, doc_tokens of the pieces of consecutive documents, and their bytes."""
    lengths, count = binary_lengths(tokens, longest)
    row = np.repeat(np.arange(len(tokens)), count)
    ends = np.cumsum(lengths)
    before = np.cumsum(tokens) - tokens
    return {
        "row": row,
        "start": ends - lengths - before[row],
        "length": lengths,
        "doc_tokens": tokens[row],
        "bounds": np.concatenate(([0], ends)) * 4,
        "data": ids.astype("<u4"),
    }


def write_sequences(
    docs: DataFrame,
    tokenizer: str,
    path: str | None = None,
    longest: int = SEQUENCE_TOKENS,
    end_id: int = END_ID,
) -> str:
    """Encode all documents, cut them and write the sequences as Parquet; returns the path.

    Every document gets `end_id` appended, so a null or empty text is one sequence of one
    token. A text of any length is cut into as many pieces as it needs. Rows with equal or
    null doc_id are packed each on their own; doc_id keeps its type. An empty table gives an
    empty one. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        own = word_ids(tokenizer)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, counts = own.encode(batch.column(1))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            cut = pieces(ids, counts + 1, longest)
            data = pa.Array.from_buffers(
                pa.large_binary(),
                len(cut["row"]),
                [None, pa.py_buffer(cut["bounds"]), pa.py_buffer(cut["data"])],
            )
            columns = [batch.column(0).take(pa.array(cut["row"]))]
            columns += [pa.array(cut[name]) for name in _FIELDS[:3]] + [data.cast(pa.binary())]
            return pa.record_batch(columns, ["doc_id", *_FIELDS])

        return each

    schema = ", ".join([f"doc_id {kind}", *map(" ".join, zip(_FIELDS, _TYPES, strict=True))])
    texts = docs.select("doc_id", text_of().alias("text"))
    path = path or f"{shared_dir(spark)}/sequences-{uuid.uuid4().hex}"
    (
        map_arrow(texts, make, schema)
        .sortWithinPartitions("length")
        .withColumn("sequence_id", F.monotonically_increasing_id())
        .write.option("compression", "zstd")
        .parquet(path)
    )
    return path


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """One row per sequence, from the files: doc_id, start, length, doc_tokens, ids (32-bit
    little-endian bytes), sequence_id. The sequence holds the ids of one piece and no padding."""
    return spark.read.parquet(path)


def packed(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece, from
    the files; `offset` is 0 everywhere, as a sequence holds one piece."""
    return read_sequences(spark, path).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        F.lit(0).cast("long").alias("offset"),
    )
