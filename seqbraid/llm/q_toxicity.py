"""Query of toxicity (1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqbraid.llm import toxicity
from seqbraid.llm.common import documents, table
from seqbraid.llm.registry import query


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.toxicity(documents(spark, sf_dir), labels)
