"""Neighbour weighting on edge tables: window edges, grouped softmax, weighted sums."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqbraid.operators.ordering import with_position
from seqbraid.operators.skew import attach
from seqbraid.session import materialise


def rank_window_edges(nodes: DataFrame, window_k: int, keys: list[str] | None = None) -> DataFrame:
    """Pairs of nodes at most floor(k/2) ranks apart in (SO, oid) order.

    Ranks beyond either end are clamped, so end nodes repeat there; self pairs
    are dropped. Slices with at most `window_k` nodes give nothing.
    """
    keys = keys or []
    ranked = materialise(
        with_position(nodes.select(*keys, "oid", "SO"), ["SO", "oid"], keys, "rank")
    )
    sizes = ranked.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > window_k)
    half = window_k // 2
    sized = attach(ranked, sizes, keys, "inner") if keys else ranked.join(F.broadcast(sizes), how="cross")
    wanted = sized.select(
        *keys,
        F.col("oid").alias("src"),
        "n",
        F.explode(F.sequence(F.col("rank") - half, F.col("rank") + half)).alias("_at"),
    ).withColumn("rank", F.greatest(F.lit(0), F.least(F.col("_at"), F.col("n") - 1)))
    others = ranked.select(*keys, F.col("oid").alias("dst"), "rank")
    return (
        wanted.join(others, [*keys, "rank"]).filter("src <> dst").select(*keys, "src", "dst")
    )


def edge_softmax(
    edges: DataFrame,
    score: str,
    keys: list[str] | None = None,
    name: str = "weight",
    temperature: str | None = None,
) -> DataFrame:
    """Softmax of `score`, over `temperature` if one is named, on the edges of each (keys, dst).

    The shift is max(0, largest score) and the denominator gets 1e-8 added. Two
    map-side combined aggregations are attached back instead of a window over
    dst, which would gather all edges of a hub in one task.
    """
    group = [*(keys or []), "dst"]
    value = F.col(score) if temperature is None else tempered(F.col(score), F.col(temperature))
    tops = materialise(edges.groupBy(*group).agg(F.greatest(F.lit(0.0), F.max(value)).alias("_top")))
    raised = attach(edges, tops, group, "inner").withColumn("_e", F.exp(value - F.col("_top")))
    sums = materialise(raised.groupBy(*group).agg((F.sum("_e") + F.lit(1e-8)).alias("_s")))
    return attach(raised, sums, group, "inner").select(
        *edges.columns, (F.col("_e") / F.col("_s")).alias(name)
    )


def tempered(score: Column, temperature: Column) -> Column:
    """Score over temperature, the temperature kept at 0.1 or more."""
    return score / F.greatest(temperature, F.lit(0.1))


def weighted_neighbor_sum(
    edges: DataFrame, vectors: DataFrame, keys: list[str] | None = None, weight: str = "weight"
) -> DataFrame:
    """(keys, dst, x): sum over edges of weight times the source's vector.

    `vectors` has (keys, oid, x) with an array column. Every task sends one partial vector
    per target, so a hub's edges do not meet before they are added up.
    """
    keys = keys or []
    sources = vectors.withColumnRenamed("oid", "src")
    wide = attach(edges.select(*keys, "src", "dst", weight), sources, [*keys, "src"], "inner")
    # Weighted before the sum, as a weight may be negative.
    scaled = array_to_vector(F.transform("x", lambda x: x * F.col(weight)))
    sums = wide.groupBy(*keys, "dst").agg(Summarizer.sum(scaled).alias("_s"))
    return sums.select(*keys, "dst", vector_to_array("_s").alias("x"))
