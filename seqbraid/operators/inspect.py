"""First look at a graph: counts, endpoint check, choice of target contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqbraid.schemas import CANONICAL_CHROMS

# --- fixed values: contig spellings tried in this order ------------------------
TARGET_PREFIXES = ["GRCh38#0#", "CHM13#0#", "id=CHM13|"]
# --- end of fixed values ------------------------------------------------------


def contig_counts(segments: DataFrame, top_k: int = 10) -> DataFrame:
    """Most frequent contigs, ties by name."""
    counts = segments.groupBy("SN").agg(F.count("*").alias("n_segments"))
    return counts.orderBy(F.desc("n_segments"), "SN").limit(top_k)


def rank_counts(segments: DataFrame, top_k: int = 20) -> DataFrame:
    return segments.groupBy("SR").agg(F.count("*").alias("n_segments")).orderBy("SR").limit(top_k)


def endpoint_check(segments: DataFrame, links: DataFrame) -> DataFrame:
    """One row: distinct link names, those without a segment, their share, five examples."""
    names = segments.select("name").distinct().withColumn("_known", F.lit(1))
    ends = links.select(F.explode(F.array("from_seg", "to_seg")).alias("name")).distinct()
    marked = ends.join(names, "name", "left")
    missing = F.col("_known").isNull()
    counts = marked.agg(
        F.count("*").alias("n_link_nodes"), F.count_if(missing).alias("n_missing")
    )
    few = marked.filter(missing).select("name").orderBy("name").limit(5)
    examples = few.agg(F.array_sort(F.collect_list("name")).alias("missing_examples"))
    return counts.join(examples, how="cross").select(  # two single-row tables
        "n_link_nodes",
        "n_missing",
        (100.0 * F.col("n_missing") / F.greatest("n_link_nodes", F.lit(1))).alias("pct_missing"),
        "missing_examples",
    )


def require_matching(check: DataFrame, limit_pct: float = 50.0) -> None:
    row = check.first()
    if row["pct_missing"] > limit_pct:
        raise ValueError(
            f"{row['pct_missing']:.1f} % of the link endpoints have no segment, "
            f"for example {row['missing_examples']}"
        )


def table_sizes(segments: DataFrame, links: DataFrame) -> DataFrame:
    """One row: segments, links, distinct contigs."""
    s = segments.agg(F.count("*").alias("n_segments"), F.countDistinct("SN").alias("n_contigs"))
    return s.join(links.agg(F.count("*").alias("n_links")), how="cross")


def canonical_targets(spark: SparkSession) -> DataFrame:
    rows = [
        (p * len(CANONICAL_CHROMS) + c, p, prefix + chrom)
        for p, prefix in enumerate(TARGET_PREFIXES)
        for c, chrom in enumerate(CANONICAL_CHROMS)
    ]
    return spark.createDataFrame(rows, "place int, family int, SN string")


def auto_targets(segments: DataFrame) -> DataFrame:
    """(SN, place): canonical contigs of the first spelling present, else the three most frequent."""
    counts = segments.groupBy("SN").agg(F.count("*").alias("n"))
    known = counts.join(F.broadcast(canonical_targets(segments.sparkSession)), "SN")
    order = Window.orderBy(F.desc("n"), "SN")
    frequent = (
        counts.orderBy(F.desc("n"), "SN")
        .limit(3)
        .select("SN", (F.row_number().over(order) - 1).alias("place"), F.lit(99).alias("family"))
    )
    both = known.select("SN", "place", "family").unionByName(frequent)
    best = both.agg(F.min("family").alias("_best"))
    return (
        both.join(F.broadcast(best), how="cross").filter("family = _best").select("SN", "place")
    )
