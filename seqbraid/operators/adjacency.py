"""Undirected adjacency of many slices at once, with hub rows split over salts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqbraid.operators.skew import CHECK_BYTES
from seqbraid.session import estimated_bytes, materialise

# Rows of one node that a single task may take in one expansion step.
HUB_ROWS = 1_000_000


def symmetric(links: DataFrame, keys: list[str]) -> DataFrame:
    """Each link in both directions with its multiplicity; a self-loop appears twice."""
    both = F.explode(
        F.array(
            F.struct(F.col("u").alias("src"), F.col("v").alias("dst")),
            F.struct(F.col("v").alias("src"), F.col("u").alias("dst")),
        )
    )
    return links.select(*keys, both.alias("e")).select(*keys, "e.src", "e.dst")


@dataclass(frozen=True)
class Adjacency:
    """`edges`: (keys, src, dst). With hubs also `salt`, and `hubs`: (keys, src, salts)."""

    keys: list[str]
    edges: DataFrame
    hubs: DataFrame | None

    @staticmethod
    def build(
        links: DataFrame,
        keys: list[str] | None = None,
        check_bytes: int = CHECK_BYTES,
        hub_rows: int = HUB_ROWS,
    ) -> Adjacency:
        """Distinct directed edges, written once. Only large inputs are searched for hubs."""
        keys = keys or []
        edges = materialise(symmetric(links, keys).distinct())
        if estimated_bytes(edges) <= check_bytes:
            return Adjacency(keys, edges, None)
        hubs = materialise(
            edges.groupBy(*keys, "src")
            .count()
            .filter(F.col("count") > hub_rows)
            .select(*keys, "src", F.ceil(F.col("count") / hub_rows).cast("long").alias("salts"))
        )
        if hubs.isEmpty():
            return Adjacency(keys, edges, None)
        # At most edges/hub_rows hubs, so this side stays small.
        salted = edges.join(F.broadcast(hubs), [*keys, "src"], "left").select(
            *edges.columns,
            F.pmod(F.xxhash64("dst"), F.expr("coalesce(salts, 1L)")).alias("salt"),
        )
        return Adjacency(keys, materialise(salted), hubs)

    def expand(self, frontier: DataFrame) -> DataFrame:
        """Every neighbour `dst` of the frontier's `node`, other frontier columns carried along."""
        front = frontier.withColumnRenamed("node", "src")
        on = [*self.keys, "src"]
        if self.hubs is not None:
            spread = F.explode(F.expr("sequence(0L, coalesce(salts, 1L) - 1L)"))
            front = (
                front.join(F.broadcast(self.hubs), on, "left")
                .withColumn("salt", spread)
                .drop("salts")
            )
            on = [*on, "salt"]
        return front.join(self.edges, on).drop("src", *(["salt"] if self.hubs is not None else []))
