"""Segment, link, interval and slice tables on disk."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqbraid.schemas import (
    ELEMENT_CLASSES,
    INTERVALS,
    LINKS,
    LINKS_REQUIRED,
    SEGMENTS,
    SEGMENTS_REQUIRED,
)

# --- fixed values: file names looked for, in order of preference --------------
DATASET_SEGMENTS = ["full_segments.csv", "full_segments.csv.gz"]
DATASET_LINKS = ["full_links.csv", "full_links.csv.gz"]
SEGMENT_FILES = [
    "full_segments.csv",
    "segments_parsed_half.csv",
    "segments_parsed_SR_larger_than_0.csv",
    "segments_parsed.csv",
    "segments.csv",
]
LINK_FILES = [
    "full_links.csv",
    "links_parsed_half.csv",
    "links_parsed.csv",
    "links.csv",
]
# --- end of fixed values ------------------------------------------------------


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """Header of a CSV file, read from its first line only."""
    return spark.read.option("header", True).csv(path).columns


# Stands for null in a CSV file; no field of a graph table has a control character.
NO_NULL = "\x00"


def missing_columns(found: Iterable[str], required: Iterable[str]) -> list[str]:
    have = set(found)
    return [c for c in required if c not in have]


def _read_checked(spark: SparkSession, path: str, schema: T.StructType, required: list[str]) -> DataFrame:
    if path.endswith(".parquet"):
        table = spark.read.parquet(path)
        absent = missing_columns(table.columns, required)
    else:
        header = csv_columns(spark, path)
        absent = missing_columns(header, required)
        types = {f.name: f.dataType for f in schema.fields}
        columns = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
        # An empty CSV field is an empty string; a segment may be called NA.
        table = (
            spark.read.schema(columns)
            .option("header", True)
            .option("emptyValue", "")
            .option("nullValue", NO_NULL)
            .csv(path)
        )
    if absent:
        raise ValueError(f"{path} lacks the columns {absent}")
    return table


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return _read_checked(spark, path, SEGMENTS, SEGMENTS_REQUIRED)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return _read_checked(spark, path, LINKS, LINKS_REQUIRED)


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Six-column BED; an unknown class is an error."""
    table = spark.read.schema(INTERVALS).option("sep", "\t").csv(path)
    unknown = [
        r[0]
        for r in table.filter(~F.col("cCRE_class").isin(ELEMENT_CLASSES))
        .select("cCRE_class")
        .distinct()
        .limit(20)
        .collect()
    ]
    if unknown:
        raise ValueError(f"unknown interval classes {sorted(unknown)}; expected {ELEMENT_CLASSES}")
    return table


def _list_files(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(path))


def find_dataset(spark: SparkSession, folder: str) -> dict[str, str]:
    """Paths of the two graph tables in a dataset folder, or an error naming the missing one."""
    present = set(_list_files(spark, folder))
    found: dict[str, str] = {}
    absent = []
    for table, names in (("segments", DATASET_SEGMENTS), ("links", DATASET_LINKS)):
        hit = next((n for n in names if n in present), None)
        if hit is None:
            absent.append(" or ".join(names))
        else:
            found[table] = f"{folder.rstrip('/')}/{hit}"
    if absent:
        raise FileNotFoundError(f"{folder} is not a dataset folder; missing: {', '.join(absent)}")
    root = folder.rstrip("/")
    return {**found, "name": root.rsplit("/", 1)[-1], "benchmark_dir": f"{root}/benchmark", "ccre_dir": f"{root}/ccre"}


def check_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """One row per graph table: path, columns, missing columns, ok."""
    paths = find_dataset(spark, folder)
    rows = []
    for table, required in (("segments", SEGMENTS_REQUIRED), ("links", LINKS_REQUIRED)):
        header = csv_columns(spark, paths[table])
        absent = missing_columns(header, required)
        rows.append((table, paths[table], sorted(header), absent, not absent))
    return spark.createDataFrame(
        rows, "table string, path string, columns array<string>, missing array<string>, ok boolean"
    )


def choose_file(
    spark: SparkSession, folder: str, kind: str, explicit: str | None = None
) -> str:
    """Pick the `segments` or `links` file: explicit name, preferred names, then any match."""
    names, required, mark = {
        "segments": (SEGMENT_FILES, SEGMENTS_REQUIRED, "seg"),
        "links": (LINK_FILES, LINKS_REQUIRED, "link"),
    }[kind]
    root = folder.rstrip("/")
    present = _list_files(spark, folder)

    def usable(name: str) -> bool:
        return not missing_columns(csv_columns(spark, f"{root}/{name}"), required)

    if explicit is not None:
        if explicit not in present:
            raise FileNotFoundError(f"{explicit} is not in {folder}")
        if not usable(explicit):
            raise ValueError(f"{explicit} lacks required {kind} columns")
        return f"{root}/{explicit}"
    plain = [n for n in present if n.endswith(".csv")]
    packed = [n for n in present if n.endswith(".csv.gz")]
    fallback = [n for n in plain + packed if mark in n.lower()]
    for name in [n for n in names if n in present] + fallback:
        if usable(name):
            return f"{root}/{name}"
    raise FileNotFoundError(f"no usable {kind} file in {folder}; needed columns {required}")


def write_gz_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


FILES_PER_CONTIG = 8
SLICE_TABLES = ("slice_segments", "slice_links", "slice_edge_pred")


def write_slices(tables: dict[str, DataFrame], manifest: DataFrame, path: str) -> None:
    """Write the long slice tables, laid out by closure and contig, and the manifest.

    The manifest has one row per slice; it only adds the two layout columns.
    """
    layout = manifest.select("slice_id", "closure", "target_sn")
    for name in SLICE_TABLES:
        table = tables[name].drop("closure", "target_sn").join(layout, "slice_id")
        # Salted by slice, so that a large contig is written by several tasks, a small one by few.
        spread = table.repartition("closure", "target_sn", F.pmod(F.xxhash64("slice_id"), F.lit(FILES_PER_CONTIG)))
        spread.write.mode("overwrite").partitionBy("closure", "target_sn").parquet(f"{path}/{name}")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")


def read_slices(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in (*SLICE_TABLES, "manifest")}


def complete_slices(tables: dict[str, DataFrame]) -> DataFrame:
    """Slice ids that occur in all three long tables."""
    first, *rest = [tables[n].select("slice_id").distinct() for n in SLICE_TABLES]
    for other in rest:
        first = first.join(other, "slice_id")
    return first
