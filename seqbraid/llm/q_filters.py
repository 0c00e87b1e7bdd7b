"""Queries of quality rules (2), near-duplicates (3) and decontamination (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbraid.llm import neardup, quality, tiling
from seqbraid.llm.common import documents, table
from seqbraid.llm.registry import query


@query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    return quality.quality_rules(docs, labels.select("doc_id", "quality"))


@query("op3_near_duplicates")
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir))


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = tiling.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return hits.withColumn("contaminated", F.lit(True))
