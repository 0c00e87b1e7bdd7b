"""Ranking scored candidate edges against a second graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqbraid.functions.names import segment_of, strand_char
from seqbraid.operators.metrics import ranking_metrics
from seqbraid.operators.ordering import with_position
from seqbraid.operators.skew import attach
from seqbraid.session import materialise, materialise_counted

PRECISION_CUTS = (10, 50, 100, 500, 1000)
TIE_BREAK = ["slice_id", "u", "v"]


def comparison_edges(links: DataFrame) -> DataFrame:
    """Distinct named, oriented edges of the comparison graph."""
    return links.select(
        F.col("from_seg").alias("u_seg"),
        F.col("from_orient").alias("u_orient"),
        F.col("to_seg").alias("v_seg"),
        F.col("to_orient").alias("v_orient"),
    ).distinct()


EDGE = ["u_seg", "u_orient", "v_seg", "v_orient"]


def candidates(
    scored: DataFrame, index: DataFrame, candidate_label: int = 0, comparison: DataFrame | None = None
) -> DataFrame:
    """Scored edges (slice_id, u, v, y, p) of one label, named, with `present_in_comparison`."""
    rows = _named(scored.filter(F.col("y") == candidate_label), index)
    return rows if comparison is None else _compared(rows, comparison)


def _named(rows: DataFrame, index: DataFrame) -> DataFrame:
    for end in ("u", "v"):
        side = index.select(F.col("segid").alias(f"_{end}"), F.col("name").alias(f"{end}_seg"))
        rows = attach(rows.withColumn(f"_{end}", segment_of(F.col(end))), side, [f"_{end}"], "inner")
        rows = rows.withColumn(f"{end}_orient", strand_char(F.col(end))).drop(f"_{end}")
    return rows.withColumnRenamed("y", "old_label")


def _compared(rows: DataFrame, comparison: DataFrame) -> DataFrame:
    known = comparison.select(*EDGE).distinct().withColumn("_known", F.lit(True))
    return (
        attach(rows, known, EDGE)
        .withColumn("present_in_comparison", F.coalesce("_known", F.lit(False)))
        .drop("_known")
    )


def top_candidates(rows: DataFrame, top_k: int = 1000) -> DataFrame:
    """Best `top_k` candidates; each task keeps its own k before the merge."""
    return rows.orderBy(F.desc("p"), *TIE_BREAK).limit(top_k)


def best_candidates(
    scored: DataFrame, index: DataFrame, candidate_label: int, comparison: DataFrame, top_k: int = 1000
) -> DataFrame:
    """`top_candidates` of `candidates`, naming and comparing only the best edges.

    Scores and ties go by ids, so the best are known before they have names. Only if one of
    them has an end that `index` does not know, and is no candidate, are all edges named first.
    """
    best = top_candidates(scored.filter(F.col("y") == candidate_label), top_k)
    best, taken = materialise_counted(best)
    rows, named = materialise_counted(_named(best, index))
    if named["rows"] < taken["rows"]:
        return top_candidates(candidates(scored, index, candidate_label, comparison), top_k)
    near = comparison.select(*EDGE).join(rows.select(*EDGE).distinct(), EDGE, "left_semi")
    return top_candidates(_compared(rows, near), top_k)


def precision_at_k(rows: DataFrame, top_k: int = 1000) -> DataFrame:
    """(k, n_used, precision) at the standard cuts, `top_k` and over all rows (k null)."""
    cuts = sorted({*PRECISION_CUTS, top_k} - {0})
    # Only the best max(cuts) rows are ordered in full; all others are just counted.
    head = materialise(
        top_candidates(rows.select("p", *TIE_BREAK, "present_in_comparison"), cuts[-1])
    )
    ranked = with_position(head, [F.desc("p"), *TIE_BREAK], name="rank")
    hit = F.col("present_in_comparison").cast("double")
    at = ranked.select("rank", hit.alias("hit"), F.explode(F.array(*map(F.lit, cuts))).alias("k"))
    by_cut = at.filter("rank < k").groupBy("k").agg(
        F.count("*").alias("n_used"), F.avg("hit").alias("precision")
    )
    whole = rows.agg(F.count("*").alias("n_used"), F.avg(hit).alias("precision"))
    return by_cut.unionByName(whole.select(F.lit(None).cast("int").alias("k"), "n_used", "precision"))


def imputation_summary(
    scored: DataFrame, index: DataFrame, comparison: DataFrame, candidate_label: int = 0, top_k: int = 1000
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(candidates, best candidates, precision table, calibration over all scored rows)."""
    rows = candidates(scored, index, candidate_label, comparison)
    return rows, top_candidates(rows, top_k), precision_at_k(rows, top_k), ranking_metrics(scored)
