"""Registered queries against their oracle on the smallest driver tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from seqbraid.operators import index as ix
from seqbraid.operators.features import pair_features
from seqbraid.plans import q_models, q_slices, views
from seqbraid.plans.views import graph

SF_DIR = "/root/testdata/sf0.001"
CHECKED = [
    "gfa_segments",
    "gfa_targeted",
    "gfa_targeted_stats",
    "node_labels",
    "class_crosstab",
    "window_counts",
    "induced_1hop",
    "slice_verify",
    "neg_distance",
    "edge_pred_set",
    "window_best",
    "components",
    "clustering_dense",
    "khop_edges",
    "khop_named",
    "avg_path",
    "node_features",
    "linear_context",
    "slice_split",
    "slice_loader_ledger",
    "slice_loader",
    "slice_loader_nodes",
    "slice_loader_edges",
    "slice_loader_pairs",
    "binary_report",
    "per_chrom_f1_present",
    "precision_at_k",
    "lr_link_support",
    "lr_link_certificate",
    "aligned_universe",
    "aligned_universe_certificate",
]

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables are absent")


@pytest.fixture
def duck():
    """A connection per test: an engine failure in one oracle leaves the others alone."""
    with duckdb.connect() as con:
        for path in Path(SF_DIR).glob("*.parquet"):
            con.execute(f"create view {path.stem} as select * from '{path}'")
        yield con


def _key(row):
    return [(v is None, "" if isinstance(v, (int, float)) else str(v), v if isinstance(v, (int, float)) else 0) for v in row]


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows(spark):
    out = contract.entry(spark)
    assert out.count() > 0 and "ccre_class" in out.columns


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_oracle(spark, duck, name):
    got = contract.queries()[name](spark, SF_DIR)
    columns = sorted(got.columns)
    result = duck.execute(contract.oracle_sql()[name])
    header = [d[0] for d in result.description]
    assert sorted(header) == columns
    places = [header.index(c) for c in columns]
    want = sorted(([r[i] for i in places] for r in result.fetchall()), key=_key)
    have = sorted((list(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()), key=_key)
    assert len(have) == len(want)
    for a, b in zip(have, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6))


def test_degree_matched_negatives_reach_neighbour_contigs(spark):
    """15,359 of 15,360 links have a feasible pair, by an all-pairs search in SQL."""
    drawn = contract.queries()["neg_distance_degree"](spark, SF_DIR)
    assert drawn.count() == 15_359
    meta = ix.oriented_metadata(graph(spark, SF_DIR).segments).select("oid", "SN")
    ends = drawn.join(meta.toDF("u", "sn_u"), "u").join(meta.toDF("v", "sn_v"), "v")
    assert ends.filter("sn_u <> sn_v").count() > 0


def test_models_and_slices_use_whole_settings(spark, monkeypatch):
    contract.queries()
    seen = {}

    def study(session, sf_dir, method, **options):
        seen[method] = options
        return {"binary": None, "per_chrom": None}

    def built(index, links, targets, window_bp, n_windows, *rest):
        seen["windows"] = n_windows
        return {"manifest": None}

    monkeypatch.setattr(q_models, "_node_study", study)
    monkeypatch.setattr(q_slices.sl, "build_slices", built)
    q_models.mlp_node(spark, SF_DIR)
    q_models.rf_node(spark, SF_DIR)
    q_slices.slice_builder(spark, SF_DIR)
    assert seen == {"mlp": {"max_iter": 200}, "random_forest": {"trees": 400}, "windows": 5}
    pair = spark.createDataFrame([(0, 2)], "u long, v long")
    meta = ix.oriented_metadata(graph(spark, SF_DIR).segments)
    nodes = ix.oriented_degree(graph(spark, SF_DIR).links)
    assert set(q_models.LINK_FEATURES) == set(pair_features(pair, meta, nodes).columns) - {"u", "v"}


def test_queries_on_segments_and_windows_build_no_links(spark, monkeypatch):
    """A folder name of its own, so that nothing built before is used."""

    def links(*_):
        raise AssertionError("links were built")

    monkeypatch.setattr(views, "raw_links", links)
    other = SF_DIR + "/"
    for key in ("contig_names", "class_weights_inverse", "covered_segments", "manifest_filter", "shared_contigs"):
        assert contract.queries()[key](spark, other).count()


def test_gfa_text_is_written_without_looking_links_up(spark, monkeypatch):
    from seqbraid.plans import q_index

    monkeypatch.setattr(views, "_graphs", {})
    # Texts are named by their number; these two leave those of other tests alone.
    monkeypatch.setattr(q_index, "_texts", dict.fromkeys(range(1000)))
    plain = sorted(r.value for r in spark.read.text(q_index.gfa_text(spark, SF_DIR)).collect())
    g = views.graph(spark, SF_DIR)
    assert not g.has_links
    assert g.links.count() == sum(line.startswith("L") for line in plain)
    monkeypatch.setattr(q_index, "_texts", dict.fromkeys(range(1001)))
    assert sorted(r.value for r in spark.read.text(q_index.gfa_text(spark, SF_DIR)).collect()) == plain


def test_one_hop_edges_are_the_links_without_building_them(spark):
    own = q_slices.fresh_slices(spark, SF_DIR, "1hop")
    edges = sorted(map(tuple, own.edges.collect()))
    assert "links" not in own.__dict__ and "kept" not in own.__dict__
    assert own.edges.columns == ["slice_id", "link_id", "u", "v"]
    assert edges and edges == sorted(map(tuple, own.links.select(*own.edges.columns).collect()))
    strict = q_slices.fresh_slices(spark, SF_DIR, "strict")
    assert strict.edges.count() == strict.links.count()
