"""Sample-to-population lookup files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbraid.schemas import POPULATIONS
from seqbraid.sources.gfa import read_lines

# --- fixed values: accepted header names --------------------------------------
SAMPLE_HEADERS = ["sample_id", "sample", "sampleid", "id"]
POPULATION_HEADERS = ["superpopulation", "super_pop", "superpop", "pop", "spop", "population"]
# --- end of fixed values ------------------------------------------------------


def read_populations(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, pop_idx): unknown labels become UNK, the last row of a sample wins."""
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"{path} is empty")
    sep = "\t" if "\t" in first[0] else ","
    header = [h.strip().lower() for h in first[0].split(sep)]

    def place(accepted: list[str], what: str) -> int:
        hits = [i for i, h in enumerate(header) if h in accepted]
        if not hits:
            raise ValueError(f"{path} has no {what} column; found {header}")
        return hits[-1]

    sample = place(SAMPLE_HEADERS, "sample_id")
    label = place(POPULATION_HEADERS, "superpopulation")
    fields = F.split("value", sep)
    known = F.array_position(F.array(*map(F.lit, POPULATIONS)), F.upper(F.trim(fields[label]))) - 1
    rows = (
        read_lines(spark, path)
        .filter("line_no > 0")
        .select(
            "line_no",
            F.trim(fields[sample]).alias("sample_id"),
            F.when(known >= 0, known).otherwise(POPULATIONS.index("UNK")).alias("pop_idx"),
        )
        .filter("sample_id <> ''")
    )
    return rows.groupBy("sample_id").agg(F.max_by("pop_idx", "line_no").cast("int").alias("pop_idx"))
