from __future__ import annotations

import hashlib
import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from frames import rows
from seqbraid.operators import attention as at
from seqbraid.operators import graph as gr
from seqbraid.operators import index as ix
from seqbraid.operators import reach as rc
from seqbraid.operators.adjacency import Adjacency

CASES = {
    "triangle": [(0, 2), (2, 4), (4, 0)],
    "chain": [(0, 2), (2, 4), (4, 6)],
    "star": [(0, 2), (0, 4), (0, 6)],
    "double": [(0, 2), (0, 2)],
    "loop": [(0, 0)],
    "pair": [(0, 2), (4, 6)],
}


@pytest.fixture(scope="module")
def graphs(spark):
    """The hand-made graphs and a random multigraph with self-loops, as slices of one table."""
    rng = random.Random(1)
    noisy = [(rng.randrange(14), rng.randrange(14)) for _ in range(45)]
    noisy += [(20 + i, 21 + i) for i in range(15)]
    cases = {**CASES, "noisy": noisy}
    data = [(k, u, v) for k, links in cases.items() for u, v in links]
    return cases, spark.createDataFrame(data, "slice_id string, u long, v long")


def _lists(links):
    out = {}
    for u, v in links:
        out.setdefault(u, []).append(v)
        out.setdefault(v, []).append(u)
    return out


def _distances(lists, source):
    dist, queue = {source: 0}, [source]
    for node in queue:
        for other in lists[node]:
            if other not in dist:
                dist[other] = dist[node] + 1
                queue.append(other)
    return dist


def test_hand_made_values(graphs):
    _, links = graphs
    stats = {r.slice_id: r for r in gr.network_summary(links, ["slice_id"]).collect()}
    assert stats["triangle"].transitivity_ref == 3.0 and stats["triangle"].transitivity == 1.0
    assert stats["triangle"].mean_clustering_coeff == 1.0
    assert stats["chain"].density == 0.5 and stats["chain"].n_branching_nodes == 0
    assert stats["double"].max_degree == 2 and stats["double"].mean_clustering_coeff == 0
    assert stats["loop"].max_degree == 2 and stats["loop"].mean_clustering_coeff == 1.0
    assert stats["pair"].n_components == 2 and stats["pair"].component_sizes_top5 == [2, 2]
    assert stats["star"].hub_oids[0] == 0 and stats["star"].degree_exponent is None
    parts = {(r.slice_id, r.oid): r.component for r in gr.components(links, ["slice_id"]).collect()}
    assert [parts["pair", o] for o in (0, 2, 4, 6)] == [0, 0, 1, 1]


def test_components_and_clustering_match_brute_force(graphs):
    cases, links = graphs
    closed = {(r.slice_id, r.oid): (r.degree, r.closed) for r in gr.closed_pairs(links, ["slice_id"]).collect()}
    parts = {(r.slice_id, r.oid): r.component for r in gr.components(links, ["slice_id"]).collect()}
    for name, pairs in cases.items():
        lists = _lists(pairs)
        for node, near in lists.items():
            found = sum(
                near[j] in lists[near[i]] for i in range(len(near)) for j in range(i + 1, len(near))
            )
            assert closed[name, node] == (len(near), found), (name, node)
        groups = {frozenset(_distances(lists, n)) for n in lists}
        order = sorted(groups, key=lambda g: (-len(g), min(g)))
        for rank, group in enumerate(order):
            assert {parts[name, n] for n in group} == {rank}


def test_power_law_uses_degrees_from_two(spark):
    degrees = spark.createDataFrame([(i, d) for i, d in enumerate([1, 2, 2, 3, 4, 6])], "oid long, degree long")
    n_links = spark.createDataFrame([(9,)], "n_edges long")
    got = gr.degree_stats(degrees, n_links).first()
    want = 1 + 5 / sum(math.log(d / 1.5) for d in [2, 2, 3, 4, 6])
    assert abs(got.degree_exponent - want) < 1e-12 and got.is_scale_free_proxy == (2 < want < 3)


def test_reach_matches_brute_force(spark, graphs):
    cases, links = graphs
    keys = ["slice_id"]
    degrees, adjacency = ix.oriented_degree(links, ("slice_id",)), Adjacency.build(links, keys)
    radii = rc.branch_distance(adjacency, degrees)
    got = {(r.slice_id, r.oid): r.radius for r in radii.collect()}
    near = {}
    for r in rc.khop_nodes(adjacency, radii).collect():
        near.setdefault((r.slice_id, r.oid), set()).add(r.nb)
    edges = {k: Counter() for k in cases}
    for r in rc.khop_edges(links, adjacency, radii).collect():
        edges[r.slice_id][r.u, r.v] += 1
    for name, pairs in cases.items():
        lists = _lists(pairs)
        wanted = Counter(pairs)
        for node in lists:
            dist = _distances(lists, node)
            hubs = [d for n, d in dist.items() if len(lists[n]) > 2]
            radius = min([*hubs, 8])
            assert got[name, node] == radius
            assert near.get((name, node), set()) == {n for n, d in dist.items() if 0 < d <= radius + 1}
            if radius >= 2:
                for n, d in dist.items():
                    if 0 < d <= radius and (node, n) not in wanted:
                        wanted[node, n] = 1
        assert edges[name] == wanted
    parts = gr.components(links, keys)
    paths = dict(rows(rc.sampled_path_length(adjacency, parts, 100)))
    for name, pairs in cases.items():
        lists = _lists(pairs)
        groups = {frozenset(_distances(lists, n)) for n in lists}
        largest = sorted(groups, key=lambda g: (-len(g), min(g)))[0]
        ds = [d for n in largest for d in _distances(lists, n).values() if d > 0]
        assert (paths[name] is None) == (not ds)
        if ds:
            assert abs(paths[name] - sum(ds) / len(ds)) < 1e-12


def test_whole_graph_needs_no_keys(spark):
    links = spark.createDataFrame(CASES["chain"], "u long, v long")
    parts = gr.components(links)
    assert {r.component for r in parts.collect()} == {0}
    assert rc.sampled_path_length(Adjacency.build(links), parts).first()[0] == 20 / 12
    radii = rc.branch_distance(Adjacency.build(links), ix.oriented_degree(links))
    assert {r.radius for r in radii.collect()} == {8}
    summary = rc.radius_summary(radii).first()
    assert summary.median_attention_radius == 8 and summary.n_linear_nodes == 4
    temps = rc.temperatures(radii, ix.oriented_degree(links)).first()
    assert temps.temp_v1 == 2.0 and abs(temps.temp_v2 - 0.3) < 1e-12


def test_rank_window_clamps_at_both_ends(spark):
    nodes = spark.createDataFrame([(i, i // 2) for i in range(6)], "oid long, SO long")
    got = Counter(rows(at.rank_window_edges(nodes, 4)))
    want = Counter(
        (i, j) for i in range(6) for o in range(-2, 3) if (j := min(5, max(0, i + o))) != i
    )
    assert got == want
    assert at.rank_window_edges(nodes, 6).count() == 0


def test_softmax_and_weighted_sum(spark):
    edges = spark.createDataFrame([(0, 9, -2.0), (1, 9, -3.0), (0, 8, 5.0)], "src long, dst long, score double")
    got = {(r.src, r.dst): r.weight for r in at.edge_softmax(edges, "score").collect()}
    low = [math.exp(-2), math.exp(-3)]  # the shift never goes below zero
    assert abs(got[0, 9] - low[0] / (sum(low) + 1e-8)) < 1e-12
    assert abs(got[0, 8] - 1 / (1 + 1e-8)) < 1e-12
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [10.0, 0.0])], "oid long, x array<double>")
    sums = at.weighted_neighbor_sum(at.edge_softmax(edges, "score"), vectors)
    value = {r.dst: r.x for r in sums.collect()}
    assert abs(value[9][0] - (got[0, 9] + 10 * got[1, 9])) < 1e-12
    signed = spark.createDataFrame([(0, 9, -2.0), (1, 9, 0.5)], "src long, dst long, weight double")
    assert at.weighted_neighbor_sum(signed, vectors).first().x == [3.0, -4.0]


def _cases_with_long_runs():
    rng = random.Random(8)
    ring = [(i, (i + 1) % 30) for i in range(30)]
    tree = [(rng.randrange(i), i) for i in range(1, 60)]
    # Runs of different lengths between a few branching nodes, one of them back to its start.
    runs, fresh = [], 100
    for _ in range(14):
        a, b, n = rng.randrange(6), rng.randrange(6), rng.randrange(1, 12)
        inner = list(range(fresh, fresh + n))
        fresh += n
        path = [a, *inner, b]
        runs += list(zip(path, path[1:]))
    tail = [(0, 900), *((900 + i, 901 + i) for i in range(40))]
    grid = [(10 * x + y, 10 * x + y + d) for x in range(7) for y in range(7) for d in (1, 10)]
    doubled = [(0, 1), (0, 1), (1, 2), (2, 3), (3, 0), (3, 3), (2, 7), (7, 8), (8, 8)]
    return {"ring": ring, "tree": tree, "runs": runs, "lollipop": ring + tail, "grid": grid, "doubled": doubled}


@pytest.mark.parametrize("n_samples", [4, 200])
def test_path_lengths_on_contracted_graphs(spark, n_samples):
    cases = _cases_with_long_runs()
    data = [(k, u, v) for k, links in cases.items() for u, v in links]
    links = spark.createDataFrame(data, "slice_id string, u long, v long")
    parts = gr.components(links, ["slice_id"])
    got = dict(rows(rc.sampled_path_length(Adjacency.build(links, ["slice_id"]), parts, n_samples)))
    for key, own in cases.items():
        lists = _lists(own)
        largest = {r.oid for r in parts.filter(f"slice_id = '{key}' and component = 0").collect()}
        order = sorted(largest, key=lambda x: (int(hashlib.md5(f"42|{x}".encode()).hexdigest()[:15], 16), x))
        far = [d for s in order[:n_samples] for d in _distances(lists, s).values() if d > 0]
        assert got[key] == pytest.approx(sum(far) / len(far), abs=1e-9)


def test_path_length_of_a_long_chain(spark):
    n = 5000
    links = spark.range(n - 1).selectExpr("id as u", "id + 1 as v")
    parts = spark.range(n).selectExpr("id as oid", "0 as component")
    began = time.monotonic()
    got = rc.sampled_path_length(Adjacency.build(links), parts).first()[0]
    assert time.monotonic() - began < 60
    order = sorted(range(n), key=lambda x: (int(hashlib.md5(f"42|{x}".encode()).hexdigest()[:15], 16), x))
    total = sum(s * (s + 1) / 2 + (n - 1 - s) * (n - s) / 2 for s in order[:200])
    assert got == pytest.approx(total / (200 * (n - 1)))


@pytest.mark.parametrize("hub_degree", [2, 3, 100])
def test_factored_neighbourhoods_expand_to_all_pairs(spark, graphs, hub_degree):
    cases, links = graphs
    keys = ["slice_id"]
    adjacency = Adjacency.build(links, keys)
    roots = ix.oriented_degree(links, ("slice_id",)).selectExpr("slice_id", "oid", "cast(oid % 5 as int) as hops")
    reach = rc.factored_khops(adjacency, roots, hub_degree)
    want = {
        (name, node, n)
        for name, pairs in cases.items()
        for lists in [_lists(pairs)]
        for node in lists
        for n, d in _distances(lists, node).items()
        if 0 < d <= node % 5
    }
    got = rows(rc.expand_khops(reach, roots).select("slice_id", "oid", "nb"))
    assert len(got) == len(set(got)) and set(got) == want
    named = roots.filter("oid % 2 = 1 and hops >= 1").withColumn("hops", F.lit(1))
    near = {
        (name, node, n)
        for name, pairs in cases.items()
        for lists in [_lists(pairs)]
        for node in lists
        for n in set(lists[node]) - {node}
        if node % 2 == 1 and node % 5 > 0
    }
    assert set(rows(rc.expand_khops(reach, named).select("slice_id", "oid", "nb"))) == near


def test_star_of_many_links_is_not_paired(spark):
    n = 100_000
    links = spark.range(1, n + 1).selectExpr("0L as u", "id as v")
    roots = spark.range(n + 1).selectExpr("id as oid", "2 as hops")
    began = time.monotonic()
    reach = rc.factored_khops(Adjacency.build(links), roots)
    assert reach.direct.count() == 2 * n and reach.gates.count() == n
    some = rc.expand_khops(reach, roots.filter("oid in (0, 5, 77)"))
    assert dict(rows(some.groupBy("oid").count())) == {0: n, 5: n, 77: n}
    assert time.monotonic() - began < 60


def test_radii_straight_from_links_are_the_searched_ones(spark, graphs):
    _, links = graphs
    keys = ["slice_id"]
    got = rc.link_radii(links, keys)
    degrees = ix.oriented_degree(links, ("slice_id",))
    want = rc.branch_distance(Adjacency.build(links, keys), degrees).join(degrees, ["slice_id", "oid"])
    columns = ["slice_id", "oid", "degree", "radius"]
    assert sorted(rows(got.select(*columns))) == sorted(rows(want.select(*columns)))


def test_hubs_are_searched_only_as_far_as_a_root_passes_them(spark):
    n = 300
    links = spark.range(1, n + 1).selectExpr("0L as u", "id as v").union(
        spark.range(1, n + 1).selectExpr("-1L as u", "id + 1000 as v")
    )
    roots = spark.createDataFrame([(5, 1), (7, 2)], "oid long, hops int")
    reach = rc.factored_khops(Adjacency.build(links), roots)
    assert reach.direct.count() == 2 + n  # two ends, and the star of 7 once
    assert dict(rows(rc.expand_khops(reach, roots).groupBy("oid").count())) == {5: 1, 7: n}
