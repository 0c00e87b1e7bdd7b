"""Node, edge, pair and context feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqbraid.functions.names import is_reference, strand_bit
from seqbraid.operators.index import oriented_degree, segment_degree
from seqbraid.operators.ordering import with_frames, with_position
from seqbraid.operators.skew import attach
from seqbraid.session import materialise

# --- fixed values: column order of the feature sets ---------------------------
NODE_FEATURES = ["SO", "LN", "SR", "is_reference", "degree", "orientation", "component"]
EDGE_FEATURES = ["delta_SO", "same_orient", "delta_SR"]
CONTEXT_FEATURES = [
    "prev_ln",
    "next_ln",
    "prev_gap",
    "next_gap",
    "rolling_ln_mean",
    "rolling_degree_mean",
]
FEATURE_SETS = {
    "coordinate": ["log1p_SO", "log1p_LN", "SR"],
    "graph": ["log1p_degree"],
    "structural": ["log1p_SO", "log1p_LN", "SR", "log1p_degree", "orient_fwd"],
    "linearized_graph": [
        "log1p_SO",
        "log1p_LN",
        "SR",
        "log1p_degree",
        *CONTEXT_FEATURES,
    ],
}
# --- end of fixed values ------------------------------------------------------


def _two_ends(
    pairs: DataFrame, table: DataFrame, keys: Sequence[str], key: str, columns: Sequence[str]
) -> DataFrame:
    """Attach `columns` of a node table to both ends u and v, suffixed _u and _v."""
    for end in ("u", "v"):
        side = table.select(
            *keys, F.col(key).alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]
        )
        pairs = attach(pairs, side, [*keys, end])
    return pairs


def pair_features(pairs: DataFrame, metadata: DataFrame, degrees: DataFrame) -> DataFrame:
    """Pair table with delta_so, summed degree, rank, length, strand, reference and contig flags.

    `degrees` is keyed by oid for one graph; a node without links counts 0. Both tables are
    put together first, so that the pairs are moved once for each end.
    """
    columns = ["SN", "SO", "LN", "SR", "is_reference"]
    nodes = metadata.select("oid", *columns).join(degrees.select("oid", "degree"), "oid", "full")
    wide = _two_ends(pairs, materialise(nodes), [], "oid", [*columns, "degree"])
    return wide.select(
        *pairs.columns,
        F.abs(F.col("SO_u") - F.col("SO_v")).alias("delta_so"),
        (F.coalesce("degree_u", F.lit(0)) + F.coalesce("degree_v", F.lit(0))).alias("deg"),
        F.col("SR_u").alias("sr_u"),
        F.col("SR_v").alias("sr_v"),
        F.col("LN_u").alias("ln_u"),
        F.col("LN_v").alias("ln_v"),
        strand_bit(F.col("u")).alias("orient_u"),
        strand_bit(F.col("v")).alias("orient_v"),
        F.col("is_reference_u").alias("is_grch38_u"),
        F.col("is_reference_v").alias("is_grch38_v"),
        (F.col("SN_u") == F.col("SN_v")).cast("int").alias("same_sn"),
    )


def _per_slice(rows: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Attach one aggregate row per slice; aggregated map-side, so a huge slice is no hot spot.

    Both are written: the rows are made once, and few slices are seen to be few, so that the
    rows are not shuffled by slice.
    """
    if not keys:
        return rows.join(F.broadcast(rows.agg(*aggregates)), how="cross")
    rows = materialise(rows)
    return attach(rows, materialise(rows.groupBy(*keys).agg(*aggregates)), keys, "inner")


def _scaled(value: Column, top: Column) -> Column:
    return F.when(top > 0, value / top).otherwise(value)


def _ranged(value: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (value - low) / (high - low)).otherwise(0.0)


def node_features(
    nodes: DataFrame, metadata: DataFrame, keys: list[str] | None = None
) -> DataFrame:
    """Seven per-node features scaled within each slice.

    `nodes` has (keys, oid, degree, component). Offset, length and degree are
    log-scaled by the slice maximum, rank and component by the slice range.
    Defaults for unknown nodes: SO 0, LN 1, SR 0.
    """
    keys = keys or []
    side = metadata.select("oid", "SO", "LN", "SR", "is_reference")
    base = attach(nodes, side, ["oid"]).select(
        *keys,
        "oid",
        F.log1p(F.abs(F.coalesce("SO", F.lit(0)))).alias("so"),
        F.log1p(F.abs(F.coalesce("LN", F.lit(1)))).alias("ln"),
        F.coalesce("SR", F.lit(0)).cast("double").alias("sr"),
        F.coalesce("is_reference", F.lit(0)).cast("double").alias("ref"),
        F.log1p(F.coalesce("degree", F.lit(0))).alias("deg"),
        F.coalesce("component", F.lit(0)).cast("double").alias("comp"),
    )
    aggregates = [F.max(c).alias(f"{c}_max") for c in ("so", "ln", "sr", "deg", "comp")]
    aggregates += [F.min(c).alias(f"{c}_min") for c in ("sr", "comp")]
    wide = _per_slice(base, keys, aggregates)
    c = F.col
    return wide.select(
        *keys,
        "oid",
        _scaled(c("so"), c("so_max")).alias("SO"),
        _scaled(c("ln"), c("ln_max")).alias("LN"),
        _ranged(c("sr"), c("sr_min"), c("sr_max")).alias("SR"),
        c("ref").alias("is_reference"),
        _scaled(c("deg"), c("deg_max")).alias("degree"),
        strand_bit(c("oid")).cast("double").alias("orientation"),
        _ranged(c("comp"), c("comp_min"), c("comp_max")).alias("component"),
    )


def edge_features(links: DataFrame, metadata: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """delta_SO and delta_SR over their slice maximum, and the same-strand flag."""
    keys = keys or []
    wide = _two_ends(links, metadata, [], "oid", ["SO", "SR"])
    base = wide.select(
        *links.columns,
        F.abs(F.coalesce("SO_u", F.lit(0)) - F.coalesce("SO_v", F.lit(0))).alias("_so"),
        F.abs(F.coalesce("SR_u", F.lit(0)) - F.coalesce("SR_v", F.lit(0))).alias("_sr"),
    )
    scaled = _per_slice(base, keys, [F.max("_so").alias("_so_max"), F.max("_sr").alias("_sr_max")])

    def share(value: str) -> Column:
        top = F.col(f"{value}_max")
        return F.when(top > 0, F.col(value) / top).otherwise(0.0)

    return scaled.select(
        *links.columns,
        share("_so").alias("delta_SO"),
        (strand_bit(F.col("u")) == strand_bit(F.col("v"))).cast("double").alias("same_orient"),
        share("_sr").alias("delta_SR"),
    )


def dense_edge_index(links: DataFrame, keys: list[str]) -> DataFrame:
    """Links with `src`, `dst`: positions of both ends in the sorted node list of the slice."""
    nodes = links.select(*keys, F.explode(F.array("u", "v")).alias("oid")).distinct()
    ranked = with_position(nodes, ["oid"], keys, "idx")
    wide = _two_ends(links, ranked, keys, "oid", ["idx"])
    return wide.select(*links.columns, F.col("idx_u").alias("src"), F.col("idx_v").alias("dst"))


def structural_features(
    segids: DataFrame, index: DataFrame, links: DataFrame, drop_reference: bool = True
) -> DataFrame:
    """Per-segment features on the forward strand; other columns of `segids` are kept."""
    side = index.select("segid", "SO", "LN", "SR", is_reference(F.col("SR"), F.col("SN")).alias("ref"))
    wide = attach(
        attach(segids, side.withColumnRenamed("SO", "_so").withColumnRenamed("LN", "_ln")
               .withColumnRenamed("SR", "_sr").withColumnRenamed("ref", "_ref"), ["segid"]),
        segment_degree(links, index).withColumnRenamed("degree", "_deg"),
        ["segid"],
    )
    columns = [
        F.log1p(F.abs(F.coalesce("_so", F.lit(0)))).alias("log1p_SO"),
        F.log1p(F.coalesce("_ln", F.lit(1))).alias("log1p_LN"),
        F.coalesce("_sr", F.lit(0)).cast("double").alias("SR"),
        F.log1p(F.coalesce("_deg", F.lit(0))).alias("log1p_degree"),
        F.lit(0.0).alias("orient_fwd"),
    ]
    if not drop_reference:
        columns.append(F.coalesce("_ref", F.lit(0)).cast("double").alias("is_reference"))
    keep = [c for c in segids.columns if c != "SR"]
    return wide.select(*keep, *columns)


def context_features(rows: DataFrame, block_rows: int = 100_000) -> DataFrame:
    """Neighbour lengths, gaps and five-row means along each chromosome, log-scaled.

    `rows` has segid, chrom, SO, LN, degree; neighbours are the previous and next
    of these rows by (SO, segid). Missing neighbours and negative gaps give 0.
    """

    def prev_gap(w) -> Column:
        return F.col("SO") - (F.lag("SO").over(w) + F.lag("LN").over(w))

    def next_gap(w) -> Column:
        return F.lead("SO").over(w) - (F.col("SO") + F.col("LN"))

    frames = {
        "prev_ln": lambda w: F.lag("LN").over(w),
        "next_ln": lambda w: F.lead("LN").over(w),
        "prev_gap": prev_gap,
        "next_gap": next_gap,
        "rolling_ln_mean": lambda w: F.avg("LN").over(w.rowsBetween(-2, 2)),
        "rolling_degree_mean": lambda w: F.avg("degree").over(w.rowsBetween(-2, 2)),
    }
    framed = with_frames(rows, ["SO", "segid"], ["chrom"], 2, frames, block_rows)
    logs = [
        F.log1p(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))).alias(c)
        for c in CONTEXT_FEATURES
    ]
    return framed.select(*rows.columns, *logs)


def feature_table(
    labels: DataFrame, index: DataFrame, links: DataFrame, feature_set: str
) -> tuple[DataFrame, list[str]]:
    """`labels` (segid, chrom, SO, LN, ..) with one of the feature sets, and its column names.

    The linear context is taken over exactly the given rows, so filter first.
    """
    if feature_set not in FEATURE_SETS:
        raise ValueError(f"unknown feature set {feature_set!r}; choose from {list(FEATURE_SETS)}")
    names = FEATURE_SETS[feature_set]
    table = structural_features(labels, index, links)
    if feature_set == "linearized_graph":
        rows = attach(
            labels.select("segid", "chrom", "SO", "LN"), segment_degree(links, index), ["segid"]
        )
        context = context_features(rows).select("segid", *CONTEXT_FEATURES)
        table = table.join(context, "segid")
    keep = [c for c in labels.columns if c not in ("SR",)]
    return table.select(*keep, *names), names


def drop_reference_feature(features: DataFrame) -> DataFrame:
    return features.drop("is_reference")


def query_edges_in_slice(edge_pred: DataFrame, slice_links: DataFrame) -> DataFrame:
    """Edge rows whose two ends are nodes of their slice."""
    nodes = slice_links.select("slice_id", F.explode(F.array("u", "v")).alias("oid")).distinct()
    for end in ("u_oid", "v_oid"):
        side = nodes.withColumnRenamed("oid", end)
        edge_pred = attach(edge_pred, side, ["slice_id", end], "left_semi")
    return edge_pred.select("slice_id", *[c for c in edge_pred.columns if c != "slice_id"])


def slice_node_table(
    slice_links: DataFrame, metadata: DataFrame, components: DataFrame
) -> DataFrame:
    """Scaled node features of every slice with the dense index `idx`."""
    degrees = oriented_degree(slice_links, ("slice_id",))
    nodes = degrees.join(components.select("slice_id", "oid", "component"), ["slice_id", "oid"])
    ranked = with_position(degrees.select("slice_id", "oid"), ["oid"], ["slice_id"], "idx")
    return node_features(nodes, metadata, ["slice_id"]).join(ranked, ["slice_id", "oid"])


def labels_on_nodes(nodes: DataFrame, labels: DataFrame, min_labeled: int = 4) -> DataFrame:
    """Slice nodes with the label of their segment, null if none; sparse slices dropped.

    `nodes` has (slice_id, oid), `labels` has (segid, ccre_label). The marked nodes are made
    once, and the few slices kept are looked up where the nodes lie.
    """
    marked = materialise(
        attach(
            nodes.withColumn("segid", F.shiftright("oid", 1)),
            labels.select("segid", "ccre_label"),
            ["segid"],
        )
    )
    enough = materialise(
        marked.groupBy("slice_id")
        .agg(F.count("ccre_label").alias("_n"))
        .filter(F.col("_n") >= min_labeled)
        .select("slice_id")
    )
    return attach(marked, enough, ["slice_id"], "left_semi")
