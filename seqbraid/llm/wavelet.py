"""Token ids in wavelet matrices: one succinct, compressed row per shard.

A shard holds the ids of consecutive documents, at most about `shard_tokens` of them.
Level by level, from the highest bit, the bits of the ids are written as a plane and
the ids are dealt, in order, into those with 0 and those with 1. Together with counts
per block of 512 bits every plane answers rank and select, so that the shard gives
token access, counts and occurrences of an id in any range without being unpacked.

The files are Parquet, a row per shard with the document ids, their lengths, the planes
and the counts per block, compressed by the file format. They are written and read by
Spark only. `access_tokens`, `count_token` and `locate_token` answer from the files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbraid.llm.common import map_arrow, ready, text_of
from seqbraid.llm.word_ids import word_ids
from seqbraid.session import scanned_bytes, shared_dir

END_ID = 1
BITS = 16
SHARD_TOKENS = 1 << 20
RANGE_BYTES = 128 << 20
BLOCK = 512

SHARD_SCHEMA = (
    "part int, seq int, part_start long, n_tokens long, doc_ids array<long>, "
    "lengths array<long>, zeros array<long>, planes array<binary>, ranks array<binary>"
)
_MATRIX = ("n_tokens", "zeros", "planes", "ranks")


def _ones_before_blocks(plane: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-len(plane) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
    padded[: len(plane)] = plane
    per_block = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1)
    return np.concatenate(([0], np.cumsum(per_block))).astype("<u4")


@dataclass
class WaveletMatrix:
    """Bit planes of n ids, highest bit first, with the number of zeros in each and the
    number of ones before each of its blocks."""

    n: int
    zeros: list[int]
    planes: list[np.ndarray]
    ranks: list[np.ndarray]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int = BITS) -> WaveletMatrix:
        planes, zeros = [], []
        kind = np.uint32 if bits > 16 else np.uint16
        ids = ids.astype(kind)
        for level in range(bits - 1, -1, -1):
            one = ids & kind(1 << level) != 0
            planes.append(np.packbits(one, bitorder="little"))
            zero = np.compress(~one, ids)
            zeros.append(len(zero))
            ids = np.concatenate((zero, np.compress(one, ids)))
        return cls(len(ids), zeros, planes, [_ones_before_blocks(p) for p in planes])

    def _rank1(self, level: int, at: int) -> int:
        block, rest = divmod(at, BLOCK)
        plane = self.planes[level][block * (BLOCK // 8) : block * (BLOCK // 8) + -(-rest // 8)]
        inside = int(np.bitwise_count(plane).sum())
        if rest % 8:
            inside -= int(plane[-1] >> (rest % 8)).bit_count()
        return int(self.ranks[level][block]) + inside

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level][at >> 3] >> (at & 7)) & 1

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, at), self._rank1(level, at)
            value = value * 2 + bit
            at = zeros + ones if bit else at - ones
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        for level, zeros in enumerate(self.zeros):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if value >> (len(self.zeros) - 1 - level) & 1:
                lo, hi = zeros + a, zeros + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id in positions lo .. hi - 1."""
        if value < 0 or value >> len(self.zeros):
            return 0
        a, b = self._range(value, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """The position of the k-th (from 0) bit of this value in a plane."""
        before = self.ranks[level].astype(np.int64)
        if not bit:
            before = np.arange(len(before), dtype=np.int64) * BLOCK - before
        block = int(np.searchsorted(before, k, "right")) - 1
        raw = self.planes[level][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)]
        bits = np.unpackbits(raw, bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def locate(self, value: int, k: int) -> int:
        """The position of the k-th occurrence (from 0) of an id."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        at = self._range(value, 0, self.n)[0] + k
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = value >> (len(self.zeros) - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def unpack(self) -> np.ndarray:
        """All ids in order; plane by plane from the lowest, each undoing one deal."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        value = np.zeros(self.n, kind)
        for level, (zeros, plane) in enumerate(zip(self.zeros[::-1], self.planes[::-1], strict=True)):
            one = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            dealt = np.empty(self.n, kind)
            dealt[~one] = value[:zeros]
            dealt[one] = value[zeros:] | kind(1 << level)
            value = dealt
        return value.astype(np.uint32)


def _shard(part: int, seq: int, start: int, docs: list, ids: list[np.ndarray]) -> pa.RecordBatch:
    matrix = WaveletMatrix.build(np.concatenate(ids))
    columns = [
        pa.array([part], pa.int32()),
        pa.array([seq], pa.int32()),
        pa.array([start], pa.int64()),
        pa.array([matrix.n], pa.int64()),
        pa.array([docs], pa.list_(pa.int64())),
        pa.array([[len(x) for x in ids]], pa.list_(pa.int64())),
        pa.array([matrix.zeros], pa.list_(pa.int64())),
        pa.array([[p.tobytes() for p in matrix.planes]], pa.list_(pa.binary())),
        pa.array([[r.tobytes() for r in matrix.ranks]], pa.list_(pa.binary())),
    ]
    return pa.record_batch(columns, [c.split()[0] for c in SHARD_SCHEMA.split(", ")])


def write_shards(
    docs: DataFrame,
    tokenizer: str,
    path: str | None = None,
    shard_tokens: int = SHARD_TOKENS,
    end_id: int = END_ID,
) -> str:
    """Encode all documents in ascending doc_id order and write them; returns the path.

    Every document gets `end_id` appended, so null and empty texts have one id. Rows with
    equal doc_id are ordered by text; null ids come first. A document longer than
    `shard_tokens` has a shard of its own. Without documents no shard is written.
    """
    spark = docs.sparkSession
    ready(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, -(-(scanned_bytes(docs) or 0) // RANGE_BYTES))
    placed = texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_ids(tokenizer)
        part = TaskContext.get().partitionId()
        seq, start, size = 0, 0, 0
        held: list[np.ndarray] = []
        names: list = []
        for batch in batches:
            flat, counts = own.encode(batch.column(1))
            ends = np.cumsum(counts)
            each = np.split(np.insert(flat, ends, end_id), (ends + np.arange(1, len(ends) + 1))[:-1])
            for name, ids in zip(batch.column(0).to_pylist(), each, strict=True):
                if held and size + len(ids) > shard_tokens:
                    yield _shard(part, seq, start, names, held)
                    seq, start, size, held, names = seq + 1, start + size, 0, [], []
                held.append(ids)
                names.append(name)
                size += len(ids)
        if held:
            yield _shard(part, seq, start, names, held)

    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    placed.mapInArrow(run, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)
    return path


def part_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """The number of ids before every range part; as many rows as the write had tasks."""
    sizes = spark.read.schema(SHARD_SCHEMA).parquet(path).groupBy("part").agg(
        F.sum("n_tokens").alias("n")
    )
    starts, total = {}, 0
    for part, n in sorted(map(tuple, sizes.collect())):
        starts[part] = total
        total += n
    return starts


def matrix_of(row: dict) -> WaveletMatrix:
    """The matrix of a shard row, with its counts per block as they stand in the file."""
    return WaveletMatrix(
        row["n_tokens"],
        list(row["zeros"]),
        [np.frombuffer(p, np.uint8) for p in row["planes"]],
        [np.frombuffer(r, "<u4") for r in row["ranks"]],
    )


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, from the files."""
    starts = part_starts(spark, path)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids = matrix_of(row).unpack()
                ends = np.cumsum(row["lengths"])
                begin = starts[row["part"]] + row["part_start"]
                for doc, n, end in zip(row["doc_ids"], row["lengths"], ends.tolist(), strict=True):
                    own = ids[end - n : end].astype("<u4")
                    out[0].append(doc)
                    out[1].append(begin + end - n)
                    out[2].append(n)
                    out[3].append(zlib.crc32(own.tobytes()))
                    if with_ids:
                        out[4].append(own)
            columns = [pa.array(x, pa.int64()) for x in out[:4]]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(out[4], pa.list_(pa.int64())))
                names.append("ids")
            return pa.record_batch(columns, names)

        return each

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    return map_arrow(shards, make, schema + (", ids array<long>" if with_ids else ""))


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path).drop("doc_ids", "lengths")


def count_token(spark: SparkSession, path: str, value: int) -> DataFrame:
    """part, seq, n: the occurrences of an id in every shard, by rank alone."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [matrix_of(r).count(value) for r in batch.to_pylist()]
            return pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["part", "seq", "n"]
            )

        return each

    return map_arrow(_shards(spark, path).select("part", "seq", *_MATRIX), make, "part int, seq int, n long")


def locate_token(spark: SparkSession, path: str, value: int) -> DataFrame:
    """position of every occurrence of an id among all ids, by rank and select on the shards."""
    starts = part_starts(spark, path)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [np.zeros(0, np.int64)]
            for row in batch.to_pylist():
                matrix = matrix_of(row)
                begin = starts[row["part"]] + row["part_start"]
                at = [matrix.locate(value, k) for k in range(matrix.count(value))]
                found.append(begin + np.array(at, np.int64))
            return pa.record_batch([pa.array(np.concatenate(found))], ["position"])

        return each

    shards = _shards(spark, path).select("part", "part_start", *_MATRIX)
    return map_arrow(shards, make, "position long")


def access_tokens(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """position, id: the ids at some positions among all ids, each read by rank from its shard.

    Positions are asked once however often they stand in `positions`; null ones and those
    outside the files are left out. A shard meets at most as many positions as it has ids.
    """
    ready(spark)
    starts = part_starts(spark, path)
    parts = spark.createDataFrame(list(starts.items()), "part int, before long")
    shards = _shards(spark, path).join(F.broadcast(parts), "part")
    shards = shards.withColumn("begin", F.col("before") + F.col("part_start"))
    # A shard stands in every bin of SHARD_TOKENS positions that it touches.
    spans = shards.select(
        F.col("part").alias("in_part"), F.col("seq").alias("in_seq"), "begin", "n_tokens"
    ).withColumn(
        "bin",
        F.explode(
            F.sequence(
                F.floor(F.col("begin") / SHARD_TOKENS),
                F.floor((F.col("begin") + F.col("n_tokens") - 1) / SHARD_TOKENS),
            )
        ),
    )
    asked = positions.select(F.col("position").cast("long").alias("position")).distinct()
    asked = asked.withColumn("bin", F.floor(F.col("position") / SHARD_TOKENS))
    placed = asked.join(spans, "bin").filter(
        (F.col("position") >= F.col("begin")) & (F.col("position") < F.col("begin") + F.col("n_tokens"))
    )
    placed = placed.select("in_part", "in_seq", "position", (F.col("position") - F.col("begin")).alias("at"))

    def read(shard: pa.Table, wanted: pa.Table) -> pa.Table:
        own = shard.slice(0, 1).to_pylist()
        matrix = matrix_of(own[0]) if own and wanted.num_rows else None
        ids = [matrix.access(at) for at in wanted["at"].to_pylist()]
        return pa.table({"position": wanted["position"], "id": pa.array(ids, pa.int64())})

    keyed = shards.select("part", "seq", *_MATRIX).groupBy("part", "seq")
    return keyed.cogroup(placed.groupBy("in_part", "in_seq")).applyInArrow(read, "position long, id long")
