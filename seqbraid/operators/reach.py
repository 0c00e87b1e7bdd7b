"""Reach on graphs: branching distance, k-hop sets, path sampling, temperatures.

Bounded searches take one equi-join of the current frontier with the adjacency for each
hop; the unbounded one for path lengths runs on a graph without its unbranched runs.
Results of every round are written, so a lost executor costs one round and plans stay short.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqbraid.functions.hashing import draw
from seqbraid.operators.adjacency import Adjacency, symmetric
from seqbraid.operators.graph import components, network_summary
from seqbraid.operators.skew import attach
from seqbraid.session import materialise, materialise_counted

MAX_RADIUS = 8
# Nodes with more neighbours are factored out of neighbourhoods.
HUB_DEGREE = 256


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _next_level(
    adjacency: Adjacency, frontier: DataFrame, levels: list[DataFrame], node: list[str]
) -> int:
    """Append the nodes one hop beyond `frontier` to `levels` and return their number.

    In an undirected graph they can only repeat nodes of the last two levels,
    so nothing older is compared against.
    """
    step = adjacency.expand(frontier).withColumnRenamed("dst", "node").distinct()
    known = _union([level.select(*node) for level in levels[-2:]])
    level, seen = materialise_counted(step.join(known, node, "left_anti"))
    levels.append(level)
    return seen["rows"]


def branch_distance(
    adjacency: Adjacency, degrees: DataFrame, max_radius: int = MAX_RADIUS
) -> DataFrame:
    """(keys, oid, radius): hops to the nearest node of degree > 2, capped at `max_radius`."""
    keys = adjacency.keys
    node = [*keys, "node"]
    start = degrees.filter("degree > 2").select(*keys, F.col("oid").alias("node"))
    levels = [materialise(start)]
    while len(levels) < max_radius and _next_level(adjacency, levels[-1], levels, node):
        pass
    hops = _union([level.withColumn("hop", F.lit(i)) for i, level in enumerate(levels)])
    nodes = degrees.select(*keys, F.col("oid").alias("node"))
    return nodes.join(hops, node, "left").select(
        *keys,
        F.col("node").alias("oid"),
        F.coalesce("hop", F.lit(max_radius)).alias("radius"),
    )


def link_radii(
    links: DataFrame, keys: list[str] | None = None, max_radius: int = MAX_RADIUS
) -> DataFrame:
    """(keys, oid, degree, radius) as `branch_distance` has it, straight from the links.

    One aggregate gives every node its degree and, as a node that does not branch has two ends
    at most, all neighbours of those. Only they are searched, from their side, so no
    adjacency is made and the many nodes that branch never move.
    """
    keys = keys or []
    node, low = [*keys, "oid"], F.col("degree") <= 2
    ends = symmetric(links, keys).groupBy(*keys, F.col("src").alias("oid"))
    ends = ends.agg(F.count("*").alias("degree"), F.min("dst").alias("a"), F.max("dst").alias("b"))
    ends = materialise(ends.select(*node, "degree", *[F.when(low, F.col(c)).alias(c) for c in "ab"]))
    near = F.explode(F.array_distinct(F.array("a", "b"))).alias("near")
    waiting = ends.filter(low).select(*node, near)
    reached = ends.filter(~low).select(*node)
    levels: list[DataFrame] = []
    while len(levels) < max_radius - 1:
        beside = reached.withColumnRenamed("oid", "near")
        level, seen = materialise_counted(
            waiting.join(beside, [*keys, "near"], "left_semi").select(*node).distinct()
        )
        if not seen["rows"]:
            break
        levels.append(level.withColumn("hop", F.lit(len(levels) + 1)))
        waiting, reached = materialise(waiting.join(level, node, "left_anti")), level
    branching = ends.filter(~low).select(*node, "degree", F.lit(0).alias("radius"))
    others = ends.filter(low).select(*node, "degree")
    if not levels:
        return branching.unionByName(others.withColumn("radius", F.lit(max_radius)))
    others = others.join(_union(levels), node, "left")
    others = others.select(*node, "degree", F.coalesce("hop", F.lit(max_radius)).alias("radius"))
    return branching.unionByName(others)


def khop_pairs(adjacency: Adjacency, roots: DataFrame) -> DataFrame:
    """(keys, oid, nb) within `hops` hops of every root, the root excluded.

    `roots` has (keys, oid, hops); each root expands only as far as its own limit.
    """
    keys = adjacency.keys
    node = [*keys, "oid", "node"]
    start = roots.filter("hops > 0").select(*keys, "oid", "hops", F.col("oid").alias("node"))
    levels, more = [materialise(start)], 1
    while more:
        live = levels[-1].filter(F.col("hops") >= len(levels))
        more = _next_level(adjacency, live, levels, node)
    return _union(levels[1:]).select(*keys, "oid", F.col("node").alias("nb"))


def khop_nodes(adjacency: Adjacency, radii: DataFrame, max_radius: int = MAX_RADIUS) -> DataFrame:
    """Neighbourhood within radius + 1 hops of every node."""
    hops = F.least("radius", F.lit(max_radius)) + 1
    return khop_pairs(adjacency, radii.select(*adjacency.keys, "oid", hops.alias("hops")))


def khop_edges(
    links: DataFrame, adjacency: Adjacency, radii: DataFrame, max_radius: int = MAX_RADIUS
) -> DataFrame:
    """All links as they are, plus (node, nb) within radius hops for nodes of radius >= 2."""
    keys = adjacency.keys
    roots = radii.filter("radius >= 2").select(
        *keys, "oid", F.least("radius", F.lit(max_radius)).alias("hops")
    )
    near = materialise(
        khop_pairs(adjacency, roots).select(
            *keys, F.col("oid").alias("u"), F.col("nb").alias("v")
        )
    )
    own = links.select(*keys, "u", "v")
    # Few links are among the pairs; only those are held against them.
    known = own.join(near, [*keys, "u", "v"], "left_semi")
    added = near.join(known, [*keys, "u", "v"], "left_anti")
    return own.unionByName(added)


@dataclass(frozen=True)
class Reach:
    """Neighbourhoods of many roots in factored form; see `factored_khops`.

    `direct`: (keys, oid, nb, hop) by ways through no hub. `gates`: (keys, oid, hub, hop,
    hops), the hubs among them that a root may pass, with the root's own limit. Hubs that a
    root passes are roots themselves.
    """

    keys: list[str]
    direct: DataFrame
    gates: DataFrame


def factored_khops(
    adjacency: Adjacency, roots: DataFrame, hub_degree: int = HUB_DEGREE
) -> Reach:
    """Neighbourhoods of `roots` (keys, oid, hops) without a row for every pair around a hub.

    A node with more than `hub_degree` neighbours is a hub. Searches stop at hubs and keep
    one row (root, hub, hops) instead of all that lies behind; what lies behind a hub is kept
    once, as the hub's own neighbourhood, as far as any root comes. A star of n links thus takes about 3n rows, not n
    squared. `expand_khops` puts the neighbourhoods of some roots together.
    """
    keys = adjacency.keys
    node = [*keys, "oid", "node"]
    hubs = materialise(
        adjacency.edges.groupBy(*keys, F.col("src").alias("node"))
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > hub_degree)
        .select(*keys, "node", F.lit(True).alias("is_hub"))
    )
    start = (
        roots.select(*keys, "oid", F.col("hops").cast("int").alias("hops"))
        .groupBy(*keys, "oid")
        .agg(F.max("hops").alias("hops"))
        .filter("hops > 0")
    )
    done = materialise(start)
    start, found = done, []
    while True:
        levels, more = [materialise(start.select(*keys, "oid", "hops", F.col("oid").alias("node")))], 1
        live = levels[0]
        while more:
            more = _next_level(adjacency, live, levels, node)
            # A hub is reached, and passed only from the root that it is itself.
            live = levels[-1].join(hubs, [*keys, "node"], "left_anti").filter(F.col("hops") > len(levels) - 1)
        rows = _union([level.withColumn("hop", F.lit(i)) for i, level in enumerate(levels) if i])
        found.append(
            materialise(rows.filter("node <> oid").groupBy(*node, "hops").agg(F.min("hop").alias("hop")))
        )
        # Hubs are searched as far as some root passes them, again where one goes further.
        asked = (
            found[-1].filter("hop < hops").join(hubs, [*keys, "node"])
            .groupBy(*keys, F.col("node").alias("oid"))
            .agg(F.max(F.col("hops") - F.col("hop")).alias("hops"))
        )
        before = done.select(*keys, "oid", F.col("hops").alias("_done"))
        further = asked.join(before, [*keys, "oid"], "left").filter("_done is null or hops > _done")
        start, seen = materialise_counted(further.select(*keys, "oid", "hops"))
        if not seen["rows"]:
            break
        done = materialise(done.unionByName(start).groupBy(*keys, "oid").agg(F.max("hops").alias("hops")))
    direct = _union(found)
    if len(found) > 1:
        widest = direct.groupBy(*node).agg(F.max("hops").alias("hops"), F.min("hop").alias("hop"))
        direct = materialise(widest.select(*node, "hops", "hop"))
    gates = direct.join(hubs, [*keys, "node"]).filter("hop < hops")
    return Reach(
        keys,
        direct.select(*keys, "oid", F.col("node").alias("nb"), "hop"),
        gates.select(*keys, "oid", F.col("node").alias("hub"), "hop", "hops"),
    )


def expand_khops(reach: Reach, roots: DataFrame) -> DataFrame:
    """(keys, oid, nb): everything within `hops` of the named roots (keys, oid, hops).

    The roots must have been given to `factored_khops` with at least these hops.
    """
    keys = reach.keys
    row = [*keys, "oid", "via"]
    held = materialise(
        roots.filter("hops > 0").select(
            *keys, "oid", F.col("oid").alias("via"), F.col("hops").cast("int").alias("left"), F.lit(True).alias("fresh")
        )
    )
    ways = reach.gates.select(*keys, F.col("oid").alias("via"), F.col("hub").alias("_hub"), "hop")
    while True:
        offered = (
            held.filter("fresh")
            .join(ways, [*keys, "via"])
            .filter("hop < left")
            .select(*keys, "oid", F.col("_hub").alias("via"), (F.col("left") - F.col("hop")).alias("_left"))
            .groupBy(*row)
            .agg(F.max("_left").alias("_left"))
        )
        further = F.col("left").isNull() | (F.col("_left") > F.col("left"))
        held, seen = materialise_counted(
            held.select(*row, "left")
            .join(offered, row, "full")
            .select(*row, F.greatest("left", "_left").alias("left"), F.coalesce(further, F.lit(False)).alias("fresh")),
            fresh=F.count_if("fresh"),
        )
        if not seen["fresh"]:
            break
    behind = reach.direct.withColumnRenamed("oid", "via")
    return (
        held.join(behind, [*keys, "via"])
        .filter("hop <= left and nb <> oid")
        .select(*keys, "oid", "nb")
        .distinct()
    )


def sampled_path_length(
    adjacency: Adjacency,
    parts: DataFrame,
    n_samples: int = 200,
    seed: int = 42,
) -> DataFrame:
    """(keys, sampled_avg_shortest_path) from hash-chosen sources in the largest component.

    Null when that component has one node. Graphs of every size are searched. Runs of nodes
    with two neighbours are contracted first (`contract_chains`), so the number of jobs
    depends on the distances between branching nodes, not on the length of the runs.
    """
    keys = adjacency.keys
    pool = parts.filter("component = 0").select(*keys, F.col("oid").alias("node"))
    order = Window.partitionBy(*keys).orderBy(draw(seed, "node"), "node")
    sources = materialise(
        pool.withColumn("_r", F.row_number().over(order))  # limited map-side before the shuffle
        .filter(F.col("_r") <= n_samples)
        .select(*keys, F.col("node").alias("source"))
    )
    inside = pool.withColumnRenamed("node", "src")
    edges = adjacency.edges.select(*keys, "src", "dst").distinct().filter("src <> dst")
    core, walks = contract_chains(materialise(edges.join(inside, [*keys, "src"], "left_semi")), pool, keys)
    total = _distance_sums(core, walks, sources, keys)
    counts = pool.groupBy(*keys).agg(F.count("*").alias("_n"))
    asked = sources.groupBy(*keys).agg(F.count("*").alias("_s"))
    pairs = F.col("_s") * (F.col("_n") - 1)
    joined = counts.join(asked, keys).join(total, keys, "left") if keys else counts.join(asked).join(total)
    return joined.select(
        *keys, F.try_divide(F.col("total"), pairs).alias("sampled_avg_shortest_path")
    )


def contract_chains(
    edges: DataFrame, nodes: DataFrame, keys: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(core nodes, walks) of connected graphs given by both directions of every link.

    Inner nodes have exactly two neighbours, all others are the core; a ring without a core
    node gets its smallest node as one. `walks` has, for every directed link (src, dst), the
    first core node `stop` that is met by following it, and the number of `hops` there. It is
    made by pointer doubling: in every round all walks are prolonged by the walk that starts
    with their last link, so that a run of n nodes takes about log2(n) rounds.
    """
    node = [*keys, "node"]
    around = edges.groupBy(*keys, F.col("src").alias("node")).agg(
        F.count("*").alias("degree"), F.sum("dst").alias("both")
    )
    around = nodes.join(around, node, "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    rings = around.groupBy(*keys).agg(
        F.when((F.min("degree") == 2) & (F.max("degree") == 2), F.min("node")).alias("_pin")
    )
    around = around.join(rings, keys) if keys else around.join(F.broadcast(rings))
    kind = (F.col("degree") != 2) | F.coalesce(F.col("node") == F.col("_pin"), F.lit(False))
    around = materialise(around.select(*node, kind.alias("core"), "both"))
    # The neighbour of an inner node that a walk does not come from.
    ahead = around.select(
        *keys, F.col("node").alias("dst"), F.col("core").alias("done"), F.col("both").alias("_both")
    )
    onward = F.when(F.col("done"), F.col("dst")).otherwise(F.col("_both") - F.col("src"))
    begun = edges.join(ahead, [*keys, "dst"]).select(
        *keys,
        "src",
        "dst",
        F.when(F.col("done"), F.col("src")).otherwise(F.col("dst")).alias("from"),
        onward.alias("stop"),
        F.when(F.col("done"), 1).otherwise(2).cast("long").alias("hops"),
    )
    stops = around.select(*keys, F.col("node").alias("stop"), F.col("core").alias("done"))
    walks, seen = materialise_counted(
        begun.join(stops, [*keys, "stop"]), open=F.count_if(~F.col("done"))
    )
    while seen["open"]:
        rest = walks.select(
            *keys,
            F.col("src").alias("from"),
            F.col("dst").alias("stop"),
            F.col("from").alias("_from"),
            F.col("stop").alias("_stop"),
            F.col("hops").alias("_hops"),
            F.col("done").alias("_done"),
        )
        longer = (
            walks.filter("not done")
            .join(rest, [*keys, "from", "stop"])
            .select(
                *keys,
                "src",
                "dst",
                F.col("_from").alias("from"),
                F.col("_stop").alias("stop"),
                (F.col("hops") + F.col("_hops") - 1).alias("hops"),
                F.col("_done").alias("done"),
            )
        )
        walks, seen = materialise_counted(
            walks.filter("done").unionByName(longer), open=F.count_if(~F.col("done"))
        )
    core = around.filter("core").select(*node)
    return core, walks.select(*keys, "src", "dst", "stop", "hops")


def _chain_sum(x: Column, y: Column, length: Column) -> Column:
    """Distances of the inner nodes of a run between ends at distances x and y, added up."""
    near = F.least(F.greatest(F.floor((y - x + length) / 2), F.lit(0)), length - 1)
    far = length - 1 - near
    return near * x + near * (near + 1) / 2 + far * y + far * (far + 1) / 2


def _core_distances(walks: DataFrame, start: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source, node, d): least distances over the contracted links from `start`."""
    row = [*keys, "source", "node"]
    weighted = materialise(
        walks.filter("src <> stop")
        .groupBy(*keys, F.col("src").alias("node"), F.col("stop").alias("to"))
        .agg(F.min("hops").alias("hops"))
    )
    known = materialise(start.groupBy(*row).agg(F.min("d").alias("d"), F.lit(True).alias("fresh")))
    while True:
        offered = (
            known.filter("fresh")
            .join(weighted, [*keys, "node"])
            .select(*keys, "source", F.col("to").alias("node"), (F.col("d") + F.col("hops")).alias("_d"))
            .groupBy(*row)
            .agg(F.min("_d").alias("_d"))
        )
        better = F.col("d").isNull() | (F.col("_d") < F.col("d"))
        known, seen = materialise_counted(
            known.select(*row, "d")
            .join(offered, row, "full")
            .select(*row, F.least("d", "_d").alias("d"), F.coalesce(better, F.lit(False)).alias("fresh")),
            fresh=F.count_if("fresh"),
        )
        if not seen["fresh"]:
            return known.select(*row, "d")


def _distance_sums(
    core: DataFrame, walks: DataFrame, sources: DataFrame, keys: list[str]
) -> DataFrame:
    """(keys, total): distances from every source to all nodes, added up.

    The inner nodes of a run between core nodes a and b need no walk: theirs follow from the
    distances of a and b. A source inside a run cuts it into two, with distance 0 at the cut.
    """
    here = core.withColumnRenamed("node", "source")
    at_core = sources.join(here, [*keys, "source"], "left_semi")
    inner = sources.join(here, [*keys, "source"], "left_anti")
    ways = materialise(inner.join(walks.withColumnRenamed("src", "source"), [*keys, "source"]))
    start = at_core.select(*keys, "source", F.col("source").alias("node"), F.lit(0).cast("long").alias("d"))
    start = start.unionByName(
        ways.select(*keys, "source", F.col("stop").alias("node"), F.col("hops").alias("d"))
    )
    # Walks between core nodes; each run stands in both directions.
    runs = materialise(walks.join(core.withColumnRenamed("node", "src"), [*keys, "src"], "left_semi"))
    near = _core_distances(runs, start, keys)

    def end(name: str) -> DataFrame:
        return near.select(*keys, "source", F.col("node").alias(name), F.col("d").alias(f"d_{name}"))

    x, y, length = F.col("d_src"), F.col("d_stop"), F.col("hops")
    along = (
        runs.filter("hops > 1")
        .select(*keys, "src", "stop", "hops")
        .join(end("src"), [*keys, "src"])
        .join(end("stop"), [*keys, "stop", "source"])
        .select(*keys, (_chain_sum(x, y, length) / 2).alias("part"))
    )
    # The two ways out of an inner source, and the run that they make up together.
    out = ways.join(end("stop"), [*keys, "source", "stop"])
    halves = out.select(*keys, _chain_sum(y, F.lit(0), length).alias("part"))
    own = out.groupBy(*keys, "source").agg(
        F.min_by("d_stop", "dst").alias("d_src"), F.max_by("d_stop", "dst").alias("d_stop"), F.sum("hops").alias("hops")
    )
    whole = own.select(*keys, (-_chain_sum(x, y, length)).alias("part"))
    parts = [near.select(*keys, F.col("d").cast("double").alias("part")), along, halves, whole]
    return _union([p.withColumn("part", F.col("part").cast("double")) for p in parts]).groupBy(*keys).agg(
        F.sum("part").alias("total")
    )


def radius_summary(radii: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distribution of the radius; it has few distinct values, so the exact median is cheap."""
    r = F.col("radius")
    n = F.count("*")
    return radii.groupBy(*(keys or [])).agg(
        F.avg(r).alias("mean_attention_radius"),
        F.median(r).alias("median_attention_radius"),
        F.max(r).alias("max_attention_radius"),
        (F.count_if(r == 0) / n).alias("frac_radius_0"),
        (F.count_if(r > 4) / n).alias("frac_radius_gt_4"),
        F.count_if(r == 0).alias("n_branching_nodes"),
        (n - F.count_if(r == 0)).alias("n_linear_nodes"),
    )


def temperatures(
    radii: DataFrame,
    degrees: DataFrame | None,
    keys: list[str] | None = None,
    low: float = 0.3,
    high: float = 2.0,
) -> DataFrame:
    """Three temperatures per node, scaled by the largest radius and degree of its slice.

    Without `degrees` the degree is a column of `radii`.
    """
    keys = keys or []
    nodes = radii if degrees is None else radii.join(degrees, [*keys, "oid"])
    top = nodes.groupBy(*keys).agg(
        F.greatest(F.max("radius"), F.lit(1)).alias("_r"), F.max("degree").alias("_d")
    )
    wide = attach(nodes, top, keys, "inner") if keys else nodes.join(F.broadcast(top), how="cross")
    share = F.col("radius") / F.col("_r")
    by_degree = F.when(F.col("_d") > 0, F.log1p("degree") / F.log1p("_d")).otherwise(0.0)

    def scaled(x: Column) -> Column:
        return F.lit(low) + x * F.lit(high - low)

    return wide.select(
        *keys,
        "oid",
        "radius",
        scaled(share).alias("temp_v1"),
        (F.lit(high) - share * F.lit(high - low)).alias("temp_v2"),
        scaled(0.6 * (1.0 - share) + 0.4 * by_degree).alias("temp_adaptive"),
    )


def attention_arrays(
    nodes: DataFrame, radii: DataFrame, temps: DataFrame, keys: list[str] | None = None
) -> DataFrame:
    """Radius and temperature for every node, 8 and 1.0 where unknown."""
    node = [*(keys or []), "oid"]
    return (
        nodes.select(*node)
        .join(radii.select(*node, "radius"), node, "left")
        .join(temps.select(*node, "temp"), node, "left")
        .select(
            *node,
            F.coalesce("radius", F.lit(MAX_RADIUS)).cast("int").alias("radius"),
            F.coalesce("temp", F.lit(1.0)).cast("float").alias("temp"),
        )
    )


def network_run(
    links: DataFrame, keys: list[str], n_samples: int = 200, seed: int = 42
) -> DataFrame:
    """One row per graph: its summary, the sampled path length and the radius distribution."""
    adjacency = Adjacency.build(links, keys)
    paths = sampled_path_length(adjacency, components(links, keys), n_samples, seed)
    radii = link_radii(links, keys)
    # The summary counts the branching nodes already.
    radius = radius_summary(radii, keys).drop("n_branching_nodes")
    return network_summary(links, keys).join(paths, keys, "left").join(radius, keys, "left")
