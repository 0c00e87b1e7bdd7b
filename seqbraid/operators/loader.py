"""Model input for every slice of a manifest in one job: nodes, edges and split query pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqbraid.functions.names import population_index
from seqbraid.operators.features import dense_edge_index, edge_features, node_features
from seqbraid.operators.graph import components, degree_stats, link_counts
from seqbraid.operators.index import oriented_degree
from seqbraid.operators.ordering import with_position
from seqbraid.operators.skew import attach
from seqbraid.operators.splits import slice_split
from seqbraid.schemas import POPULATIONS
from seqbraid.session import materialise


@dataclass(frozen=True)
class LoadedSlices:
    """Tables that share slice_id; nodes are numbered 0.. in the order of their oid.

    `ledger` has every row of the manifest with its counts and, where the slice was not
    loaded, the reason. The other tables hold loaded slices only.
    """

    ledger: DataFrame
    slices: DataFrame
    nodes: DataFrame
    edges: DataFrame
    pairs: DataFrame


def _ranked_nodes(degrees: DataFrame) -> DataFrame:
    ranked = with_position(degrees.select("slice_id", "oid"), ["oid"], ["slice_id"], "idx")
    return materialise(ranked)


def _pairs_inside(pairs: DataFrame, ranked: DataFrame) -> DataFrame:
    """Pairs whose two ends are nodes of their slice, with the positions of both."""
    for end in ("u", "v"):
        side = ranked.select(
            "slice_id", F.col("oid").alias(f"{end}_oid"), F.col("idx").alias(f"query_{end}")
        )
        pairs = attach(pairs, side, ["slice_id", f"{end}_oid"], "inner")
    return pairs


def _reason(min_train: int) -> Column:
    """Why a slice is left out, the first that holds; null for a loaded one."""
    return (
        F.when(F.col("n_links") == 0, "no links")
        .when(F.col("n_pairs") == 0, "no query pairs")
        .when(F.col("n_inside") == 0, "no query pair inside")
        .when(F.col("n_train") < min_train, "too few train pairs")
    )


def _ledger(
    manifest: DataFrame, links: DataFrame, pairs: DataFrame, inside: DataFrame, min_train: int
) -> DataFrame:
    counts = {"n_links": links, "n_pairs": pairs, "n_inside": inside}
    out = manifest
    for name, rows in counts.items():
        found = rows.groupBy("slice_id").agg(F.count("*").alias(name))
        out = out.join(found, "slice_id", "left").na.fill(0, [name])
    n = F.col("n_inside")
    train = n - F.floor(n * F.lit(0.2)) - F.floor(n * F.lit(0.1))
    return out.withColumn("n_train", train).withColumn("reason", _reason(min_train))


def load_slices(
    manifest: DataFrame,
    links: DataFrame,
    edge_pred: DataFrame,
    metadata: DataFrame,
    populations: DataFrame,
    order: tuple[str, ...] = ("shuffle_key", "u_oid", "v_oid"),
    seed: int = 42,
    min_train: int = 10,
) -> LoadedSlices:
    """The slices of `manifest` (slice_id, target_sn, closure) as tables a model reads.

    `links` has (slice_id, link_id, u, v), `edge_pred` (slice_id, u_oid, v_oid, label and
    the columns of `order`, which together identify a row), `metadata` is keyed by oid,
    `populations` by sample. Pairs with an end outside their slice are left out. A slice
    without links, pairs or pairs inside, or with fewer than `min_train` train pairs, is
    not loaded; the ledger says why. Nodes carry the seven scaled features, the unscaled
    offset `position` and the population; a node without metadata
    has position 0 and the unknown population.
    """
    links = links.select("slice_id", "link_id", "u", "v")
    ranked = _ranked_nodes(oriented_degree(links, ("slice_id",)))
    inside = materialise(_pairs_inside(edge_pred, ranked))
    ledger = materialise(_ledger(manifest, links, edge_pred, inside, min_train))
    loaded = ledger.filter("reason is null")
    kept = materialise(attach(links, loaded.select("slice_id"), ["slice_id"], "left_semi"))

    degrees = materialise(oriented_degree(kept, ("slice_id",)))
    parts = components(kept, ["slice_id"]).select("slice_id", "oid", "component")
    scaled = node_features(degrees.join(parts, ["slice_id", "oid"]), metadata, ["slice_id"])
    # One row per contig meets the samples, so a sample that owns most rows is no hot key.
    contigs = population_index(metadata.select("SN").distinct(), populations)
    places = attach(
        metadata.select("oid", "SN", F.col("SO").alias("position")), contigs, ["SN"]
    ).select("oid", "position", "pop_idx")
    nodes = attach(scaled.join(ranked, ["slice_id", "oid"]), places, ["oid"])
    nodes = nodes.withColumns(
        {
            "position": F.coalesce("position", F.lit(0)),
            "pop_idx": F.coalesce("pop_idx", F.lit(POPULATIONS.index("UNK"))),
        }
    )

    edges = edge_features(dense_edge_index(kept, ["slice_id"]), metadata, ["slice_id"])
    pairs = materialise(slice_split(inside, list(order), seed, min_train=min_train))

    sizes = degree_stats(degrees, link_counts(kept, ["slice_id"]), ["slice_id"])
    labelled = pairs.groupBy("slice_id").agg(
        F.count_if(F.col("label") == 1).alias("n_pos"),
        F.count_if(F.col("label") == 0).alias("n_neg"),
        F.count_if(F.col("split") == "val").alias("n_val"),
        F.count_if(F.col("split") == "test").alias("n_test"),
    )
    slices = (
        loaded.drop("reason", "n_pairs", "n_inside")
        .join(sizes.select("slice_id", "n_nodes", "branching_frac"), "slice_id")
        .join(labelled, "slice_id")
    )
    return LoadedSlices(
        ledger,
        slices,
        nodes,
        edges.select("slice_id", "link_id", "src", "dst", "delta_SO", "same_orient", "delta_SR"),
        pairs.select("slice_id", *order, "query_u", "query_v", "label", "split"),
    )
