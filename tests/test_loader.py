"""The slice loader: drop rules, positions and pairs on a hand-made manifest."""

from __future__ import annotations

from frames import rows
from seqbraid.operators.loader import load_slices

EDGE_PRED = "slice_id string, u_oid long, v_oid long, label int, shuffle_key long"


def _load(spark, links, pairs, slices=("full", "no_links", "no_pairs", "outside", "small")):
    manifest = spark.createDataFrame(
        [(s, "GRCh38#0#chr1", "strict") for s in slices],
        "slice_id string, target_sn string, closure string",
    )
    meta = spark.createDataFrame(
        [(oid, sn, so, 10, 0, 1) for oid, sn, so in
         [(o, "GRCh38#0#chr1" if o < 8 else "HG001#1#chr1", 100 * o) for o in range(12)]],
        "oid long, SN string, SO long, LN long, SR int, is_reference int",
    )
    listed = spark.createDataFrame([("HG001", 2)], "sample_id string, pop_idx int")
    return load_slices(
        manifest,
        spark.createDataFrame(links, "slice_id string, link_id long, u long, v long"),
        spark.createDataFrame(pairs, EDGE_PRED),
        meta,
        listed,
    )


def _ring(name, oids):
    return [(name, i, a, b) for i, (a, b) in enumerate(zip(oids, oids[1:] + oids[:1]))]


def _fixture():
    links = _ring("full", [2, 4, 8]) + _ring("no_pairs", [2, 4]) + _ring("outside", [2, 4])
    links += _ring("small", [2, 4, 6]) + [("full", 9, 4, 99)]
    pairs = [("full", 2, 4, i % 2, i) for i in range(14)] + [("full", 2, 10, 1, 77)]
    pairs += [("no_links", 2, 4, 1, 0), ("outside", 2, 6, 1, 0), ("small", 2, 4, 1, 0), ("small", 2, 4, 1, 0)]
    return links, pairs


def test_every_slice_is_loaded_or_has_its_reason(spark):
    got = _load(spark, *_fixture())
    assert rows(got.ledger.select("slice_id", "n_links", "n_pairs", "n_inside", "n_train", "reason"), "slice_id") == [
        ("full", 4, 15, 14, 11, None),
        ("no_links", 0, 1, 0, 0, "no links"),
        ("no_pairs", 2, 0, 0, 0, "no query pairs"),
        ("outside", 2, 1, 0, 0, "no query pair inside"),
        ("small", 3, 2, 2, 2, "too few train pairs"),
    ]
    for table in (got.slices, got.nodes, got.edges, got.pairs):
        assert {r.slice_id for r in table.select("slice_id").collect()} == {"full"}


def test_nodes_are_numbered_by_oid_and_edges_and_pairs_use_the_numbers(spark):
    got = _load(spark, *_fixture())
    assert rows(got.nodes.select("idx", "oid", "position", "pop_idx"), "idx") == [
        (0, 2, 200, 6),
        (1, 4, 400, 6),
        (2, 8, 800, 2),
        (3, 99, 0, 5),
    ]
    assert rows(got.edges.select("link_id", "src", "dst"), "link_id") == [
        (0, 0, 1),
        (1, 1, 2),
        (2, 2, 0),
        (9, 1, 3),
    ]
    assert rows(got.pairs.groupBy("split", "query_u", "query_v").count(), "split") == [
        ("test", 0, 1, 2),
        ("train", 0, 1, 11),
        ("val", 0, 1, 1),
    ]
    row = got.slices.first()
    assert (row.n_nodes, row.branching_frac, row.n_pos, row.n_neg) == (4, 0.25, 7, 7)


def test_empty_tables_load_nothing(spark):
    got = _load(spark, [], [], ["alone"])
    assert [r.reason for r in got.ledger.collect()] == ["no links"]
    assert got.nodes.count() == got.edges.count() == got.pairs.count() == got.slices.count() == 0
