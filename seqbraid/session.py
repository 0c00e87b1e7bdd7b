"""Session defaults, durable intermediate tables and size estimates."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The planner's size for sources it knows nothing about is above this.
UNKNOWN_BYTES = 1 << 60
# A row's bytes in memory over its bytes in a Parquet file. Slice ids, contigs and small
# numbers shrink about so much in a file.
MEMORY_FACTOR = 16
_FACTOR_KEY = "spark.sql.sources.fileCompressionFactor"


def build_session(app: str = "seqbraid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; `conf` entries override the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        _FACTOR_KEY: str(MEMORY_FACTOR),
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def plan_by_memory(spark: SparkSession) -> None:
    """Let the planner take tables at their size in memory, unless the session has set a factor.

    A broadcast is gathered in the driver as rows, not as the file it comes from. Taken by
    their files, tables of some million rows pass for small ones. A table that turns out to be
    small once it is shuffled is still broadcast by adaptive execution.
    """
    if float(spark.conf.get(_FACTOR_KEY, "1.0")) == 1.0:
        spark.conf.set(_FACTOR_KEY, str(MEMORY_FACTOR))


def import_in_workers(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed on the workers."""
    root = str(Path(__file__).resolve().parents[1])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{paths}".rstrip(":")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: `spark.checkpoint.dir` as the cluster set it.

    Only a local-mode session may fall back to a temporary folder; on a cluster
    a machine-local path would lose the table together with the executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="spark-tables-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet in the shared folder and return a scan of it.

    This cuts lineage like a reliable checkpoint, survives executor loss, and
    unlike one it keeps column pruning and gives the planner exact sizes, so a
    later join is broadcast only when the table really is below the threshold.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_counted(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """`materialise`, and the row count (`rows`) and other aggregates of the table.

    Read back from the written files, where a count needs only their footers.
    An Observation on the write would be free, but its manager makes the session
    unserialisable, and fitted ML models carry the session in their summary.
    """
    table = materialise(df)
    extra = [column.alias(name) for name, column in metrics.items()]
    return table, table.agg(F.count(F.lit(1)).alias("rows"), *extra).first().asDict()


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; exact for Parquet scans, an upper guess otherwise."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def scanned_bytes(df: DataFrame) -> int | None:
    """The file sizes of all scans below `df` added up; None if a source does not state its size.

    Unlike `estimated_bytes` this does not multiply the two sides of a join, so it stays
    in proportion to the data. An unknown source has Spark's default, above any table.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    if any(size >= UNKNOWN_BYTES for size in sizes):
        return None
    return int(sum(sizes) / float(df.sparkSession.conf.get(_FACTOR_KEY, "1.0")))


def broadcast_limit(spark: SparkSession) -> int:
    raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    digits = raw.lower().rstrip("b")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(digits[-1:], 0)
    return int(digits[:-1]) * scale if scale else int(digits)
