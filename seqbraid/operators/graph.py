"""Graph statistics for all slices in one job.

`links` holds (keys.., u, v) with one row per link; `keys` names the columns
that separate slices, empty for one whole graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqbraid.operators.adjacency import symmetric
from seqbraid.operators.index import oriented_degree
from seqbraid.operators.ordering import with_position
from seqbraid.operators.skew import attach
from seqbraid.session import materialise, materialise_counted



def component_labels(links: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, oid, root): root is the smallest oid of the connected component.

    Alternates two contractions until nothing changes: every node hands its
    larger neighbours to its smallest one, then its smaller neighbours. Each
    round moves one row per edge and needs O(log n) rounds; the edge list is
    written between rounds.
    """
    keys = keys or []
    nodes = links.select(*keys, F.explode(F.array("u", "v")).alias("oid")).distinct()
    edges, state = _written(
        links.filter("u <> v")
        .select(*keys, F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo"))
        .distinct()
    )
    previous = None
    while state != previous:
        previous = state
        edges, state = _written(_contract_smaller(_contract_larger(edges, keys), keys))
    roots = edges.groupBy(*keys, F.col("hi").alias("oid")).agg(F.min("lo").alias("root"))
    return nodes.join(roots, [*keys, "oid"], "left").withColumn("root", F.coalesce("root", "oid"))


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edge list as a table, with a fingerprint that shows whether a round changed it."""
    digest = F.sum(F.xxhash64(*edges.columns).cast("decimal(38,0)"))
    return materialise_counted(edges, digest=digest)


def _contract_larger(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = symmetric(edges.select(*keys, F.col("hi").alias("u"), F.col("lo").alias("v")), keys)
    lowest = both.groupBy(*keys, "src").agg(F.min("dst").alias("_m"))
    up = both.filter("dst > src")
    return (
        attach(up, lowest, [*keys, "src"], "inner")
        .select(*keys, F.col("dst").alias("hi"), F.least("src", "_m").alias("lo"))
        .distinct()
    )


def _contract_smaller(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Link the smaller neighbours of a node, and the node, to the smallest neighbour."""
    lowest = edges.groupBy(*keys, "hi").agg(F.min("lo").alias("_m"))
    moved = attach(edges, lowest, [*keys, "hi"], "inner").select(
        *keys, F.explode(F.array("hi", "lo")).alias("hi"), F.col("_m").alias("lo")
    )
    return moved.filter("hi <> lo").distinct()


def components(links: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, oid, component): 0 is the largest; equal sizes by smallest oid."""
    keys = keys or []
    labels = materialise(component_labels(links, keys))
    ranked = with_position(
        labels.groupBy(*keys, "root").agg(F.count("*").alias("size")),
        [F.desc("size"), "root"],
        keys,
        "component",
    )
    return attach(labels, ranked, [*keys, "root"], "inner").select(
        *keys, "oid", "component", "size"
    )


def degree_histogram(degrees: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return degrees.groupBy(*(keys or []), "degree").agg(F.count("*").alias("n_nodes"))


def hubs(degrees: DataFrame, keys: list[str] | None = None, top_k: int = 10) -> DataFrame:
    """Top nodes by degree per slice, ties by oid. The rank filter is applied map-side first."""
    order = Window.partitionBy(*(keys or [])).orderBy(F.desc("degree"), "oid")
    return degrees.withColumn("hub_rank", F.row_number().over(order)).filter(
        F.col("hub_rank") <= top_k
    )


def _sum_degree_log(d_min: int) -> Column:
    return F.sum(F.when(F.col("degree") >= d_min, F.ln(F.col("degree") / (d_min - 0.5))))


def degree_stats(
    degrees: DataFrame, n_links: DataFrame, keys: list[str] | None = None, d_min: int = 2
) -> DataFrame:
    """Counts, mean and max degree, branching share, density and power-law exponent.

    `n_links` has (keys, n_edges). The exponent is null below five usable nodes.
    """
    keys = keys or []
    usable = F.count_if(F.col("degree") >= d_min)
    stats = degrees.groupBy(*keys).agg(
        F.count("*").alias("n_nodes"),
        F.avg("degree").alias("mean_degree"),
        F.max("degree").alias("max_degree"),
        F.count_if(F.col("degree") > 2).alias("n_branching_nodes"),
        F.count_if(F.col("degree") == 0).alias("n_isolated"),
        F.when(usable >= 5, 1.0 + usable / _sum_degree_log(d_min)).alias("degree_exponent"),
    )
    n = F.col("n_nodes").cast("double")  # the product of two counts may not fit a long
    joined = stats.join(n_links, keys) if keys else stats.join(n_links, how="cross")
    return joined.select(
        *keys,
        "n_nodes",
        "n_edges",
        F.when(n > 1, 2.0 * F.col("n_edges") / (n * (n - 1))).otherwise(0.0).alias("density"),
        "mean_degree",
        "max_degree",
        "n_branching_nodes",
        (F.col("n_branching_nodes") / n).alias("branching_frac"),
        "n_isolated",
        "degree_exponent",
        F.coalesce(
            (F.col("degree_exponent") > 2) & (F.col("degree_exponent") < 3), F.lit(False)
        ).alias("is_scale_free_proxy"),
    )


def link_counts(links: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return links.groupBy(*(keys or [])).agg(F.count("*").alias("n_edges"))


def closed_pairs(links: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, oid, degree, closed): closed neighbour-list pairs, multiplicity included.

    A node's list repeats a neighbour once per link and names the node itself
    twice per self-loop. Pairs of different neighbours close when those are
    linked, which splits into

    * triangles: product of the two multiplicities, found once per triangle by
      orienting every edge from the lower to the higher (degree, oid). A node
      then has at most sqrt(2E) outgoing edges, which bounds every join group;
    * the node itself with another neighbour: always linked;
    * one neighbour with its own copy: linked when it has a self-loop.
    """
    keys = keys or []
    node = [*keys, "oid"]
    degrees = materialise(oriented_degree(links, tuple(keys)))
    pairs = materialise(
        links.groupBy(*keys, F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(
            F.count("*").alias("m")
        )
    )
    loops = pairs.filter("a = b").select(*keys, F.col("a").alias("oid"), (2 * F.col("m")).alias("own"))
    simple = pairs.filter("a <> b")

    def with_degree(df: DataFrame, column: str) -> DataFrame:
        side = degrees.select(*keys, F.col("oid").alias(column), F.col("degree").alias(f"d_{column}"))
        return attach(df, side, [*keys, column], "inner")

    ranked = with_degree(with_degree(simple, "a"), "b")
    swap = F.struct("d_a", "a") > F.struct("d_b", "b")
    out = materialise(
        ranked.select(
            *keys,
            F.when(swap, F.col("b")).otherwise(F.col("a")).alias("x"),
            F.when(swap, F.col("a")).otherwise(F.col("b")).alias("y"),
            F.when(swap, F.col("d_a")).otherwise(F.col("d_b")).alias("dy"),
            "m",
        )
    )
    first = out.select(*keys, "x", "y", F.col("dy").alias("d1"), F.col("m").alias("m_xy"))
    second = out.select(*keys, "x", F.col("y").alias("z"), F.col("dy").alias("d2"), F.col("m").alias("m_xz"))
    closing = out.select(*keys, F.col("x").alias("y"), F.col("y").alias("z"), F.col("m").alias("m_yz"))
    wedges = first.join(second, [*keys, "x"]).filter(F.struct("d1", "y") < F.struct("d2", "z"))
    corners = F.explode(
        F.array(
            F.struct(F.col("x").alias("oid"), (F.col("m_xy") * F.col("m_xz")).alias("w")),
            F.struct(F.col("y").alias("oid"), (F.col("m_xy") * F.col("m_yz")).alias("w")),
            F.struct(F.col("z").alias("oid"), (F.col("m_xz") * F.col("m_yz")).alias("w")),
        )
    )
    triangles = (
        wedges.join(closing, [*keys, "y", "z"]).select(*keys, corners.alias("c")).select(*keys, "c.oid", "c.w")
    )
    own_pairs = attach(loops, degrees, node, "inner").select(
        *node,
        (F.col("own") * (F.col("degree") - F.col("own")) + F.col("own") * (F.col("own") - 1) / 2)
        .cast("long")
        .alias("w"),
    )
    ends = F.explode(
        F.array(
            F.struct(F.col("a").alias("nb"), F.col("b").alias("oid")),
            F.struct(F.col("b").alias("nb"), F.col("a").alias("oid")),
        )
    )
    repeated = simple.filter("m > 1").select(*keys, ends.alias("e"), "m").select(*keys, "e.*", "m")
    looped = loops.select(*keys, F.col("oid").alias("nb"))
    copies = attach(repeated, looped, [*keys, "nb"], "left_semi").select(
        *node, (F.col("m") * (F.col("m") - 1) / 2).cast("long").alias("w")
    )
    closed = (
        triangles.unionByName(own_pairs)
        .unionByName(copies)
        .groupBy(*node)
        .agg(F.sum("w").alias("closed"))
    )
    return degrees.join(closed, node, "left").select(
        *node, "degree", F.coalesce("closed", F.lit(0)).cast("long").alias("closed")
    )


def local_clustering(closed: DataFrame) -> DataFrame:
    """Add `clustering`: closed pairs over all pairs, 0 below degree 2."""
    k = F.col("degree").cast("double")
    return closed.withColumn(
        "clustering", F.when(k >= 2, 2.0 * F.col("closed") / (k * (k - 1))).otherwise(0.0)
    )


def clustering_summary(closed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean clustering and both transitivities.

    A triangle is met at all three corners, so three times the closed share,
    `transitivity_ref`, is 3 for a lone triangle; `transitivity` is a third of it.
    """
    k = F.col("degree").cast("double")
    share = F.sum("closed") / F.sum((k * (k - 1) / 2))
    share = F.coalesce(F.when(F.sum(k * (k - 1)) > 0, share), F.lit(0.0))
    return (
        local_clustering(closed)
        .groupBy(*(keys or []))
        .agg(
            F.avg("clustering").alias("mean_clustering_coeff"),
            (3.0 * share).alias("transitivity_ref"),
            share.alias("transitivity"),
        )
    )


def component_summary(parts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Number of components, share of the largest, the five largest sizes."""
    keys = keys or []
    sizes = parts.groupBy(*keys, "component").agg(F.count("*").alias("size"))
    top = F.array_compact(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("component") < 5, F.struct("component", "size")))),
            lambda s: s["size"],
        )
    )
    return sizes.groupBy(*keys).agg(
        F.count("*").alias("n_components"),
        (F.max("size") / F.sum("size")).alias("largest_component_frac"),
        top.alias("component_sizes_top5"),
    )


def network_summary(
    links: DataFrame,
    keys: list[str],
    top_k: int = 10,
    paths: DataFrame | None = None,
) -> DataFrame:
    """One row of network statistics per slice; `paths` adds sampled mean path lengths."""
    degrees = materialise(oriented_degree(links, tuple(keys)))
    stats = degree_stats(degrees, link_counts(links, keys), keys)
    parts = component_summary(components(links, keys), keys)
    closed = clustering_summary(closed_pairs(links, keys), keys)
    ranked = (
        hubs(degrees, keys, top_k)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("hub_rank", "oid", "degree"))).alias("_h"))
        .select(*keys, F.col("_h.oid").alias("hub_oids"), F.col("_h.degree").alias("hub_degrees"))
    )
    out = stats.join(parts, keys).join(closed, keys).join(ranked, keys)
    if paths is not None:
        out = out.join(paths, keys, "left")
    return out
