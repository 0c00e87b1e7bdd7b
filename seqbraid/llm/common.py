"""Helpers shared by the operators: tables, worker set-up and Arrow mapping."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqbraid.session import materialise

__all__ = ["documents", "kept", "map_arrow", "materialise", "ready", "table", "text_of"]

_ROOT = str(Path(__file__).resolve().parents[2])
# A batch is held by the executor and its worker, with its strings and results some ten times.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed on the workers, and
    send them small batches, unless the session has set a size."""
    if _BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{_ROOT}:{paths}".rstrip(":")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))


def text_of(column: str = "text"):
    """The text with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


_kept: dict[tuple[Callable, str], object] = {}
_used: set[tuple[Callable, str]] = set()


def kept(build: Callable[[str], object], path: str):
    """What `build` makes of a file, kept by a Python worker from task to task of one kind."""
    key = build, path
    _used.add(key)
    if key not in _kept:
        _kept[key] = build(path)
    return _kept[key]


def begin() -> None:
    """Forget which kept tables are in use; called before a task asks for its own."""
    _used.clear()


def drop_unused() -> None:
    """Drop the tables kept for earlier tasks that this one has not asked for.

    A tokenizer with its memo may be some hundred MB, and a worker goes on to other stages.
    """
    for key in _kept.keys() - _used:
        del _kept[key]


def give_back() -> None:
    """Return freed memory to the system.

    A worker outlives its task. What its allocators keep would count against the executor in
    all later stages, also in those without Python.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim is not None:
        trim(0)


def map_arrow(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]],
    schema: StructType | str,
) -> DataFrame:
    """Apply a per-batch function in every task; `make` builds it once in a task."""
    ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        each = make()
        drop_unused()
        out = None
        try:
            for batch in batches:
                out = each(batch)
                if out is not None and out.num_rows:
                    yield out
        finally:
            del each, out
            give_back()

    return df.mapInArrow(run, schema)


def lookup(rows: DataFrame, found: DataFrame, key: str, count: str, hot_rows: int) -> DataFrame:
    """Inner join of `rows` to `found`, one row per key with the `count` of rows that have it.

    Keys with at least `hot_rows` rows, so at most rows / hot_rows of them, are broadcast;
    the others, none of which fills a task, meet by a shuffle.
    """
    hot = found.filter(F.col(count) >= hot_rows)
    cold = found.filter(F.col(count) < hot_rows)
    by_hot = rows.join(F.broadcast(hot), key)
    by_cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return by_hot.unionByName(by_cold)
