from __future__ import annotations

import math
import random
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from frames import rows
from seqbraid.operators import features as ft
from seqbraid.operators import labels as lb
from seqbraid.operators import metrics as mt
from seqbraid.operators import models as md
from seqbraid.operators.link_scorer import score_links
from seqbraid.operators import ranking as rk
from seqbraid.operators import splits as sp
from seqbraid.plans.workflows import fit_and_report


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(4)
    data = [("big" if i % 3 else rng.choice("abc"), int(rng.random() < 0.4), rng.randrange(8) / 8) for i in range(400)]
    data += [("one", 1, 0.5), ("one", 1, 0.25)]
    return data, spark.createDataFrame(data, "g string, y int, p double")


def test_ranking_metrics_match_pair_counting(scored):
    data, df = scored
    got = {r.g: r for r in mt.ranking_metrics(df, ["g"]).collect()}
    limits = dict(rows(mt.best_threshold(df, ["g"])))
    for g in {r[0] for r in data}:
        part = [(y, p) for k, y, p in data if k == g]
        pos, neg = [p for y, p in part if y], [p for y, p in part if not y]
        assert abs(got[g].brier - sum((p - y) ** 2 for y, p in part) / len(part)) < 1e-12
        if not neg:
            assert got[g].auroc is None and got[g].auprc is None and limits[g] == 0.5
            continue
        wins = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
        assert abs(got[g].auroc - wins / (len(pos) * len(neg))) < 1e-12
        area, f1, seen = 0.0, {}, 0
        for t in sorted({p for _, p in part}, reverse=True):
            hits = sum(p >= t for p in pos)
            called = sum(p >= t for _, p in part)
            area += (hits - seen) / len(pos) * hits / called
            seen = hits
            f1[t] = 2 * hits / (called + len(pos))
        assert abs(got[g].auprc - area) < 1e-12
        assert limits[g] == min(t for t in f1 if f1[t] == max(f1.values()))


def test_empty_input_gives_defaults(spark):
    empty = spark.createDataFrame([], "slice_id string, y int, p double")
    assert mt.best_threshold(empty).first().threshold == 0.5
    assert mt.mean_slice_auc(mt.slice_auc(empty)).first().mean_auc == 0.5
    assert mt.ranking_metrics(empty, ["slice_id"]).count() == 0


def test_binary_report_with_one_class(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.1)], "y int, p double")
    r = mt.binary_report(df, 0.5).first()
    # Class 0 is predicted but never true: it counts in macro-F1, not in balanced accuracy.
    assert abs(r.macro_f1 - (2 / 3) / 2) < 1e-12 and r.balanced_accuracy == 0.5
    assert r.precision == 1.0 and r.auroc is None


def test_macro_f1_variants(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "y int, pred int")
    report = mt.class_report(df, ["a", "b", "c"])
    assert [r.support for r in report.orderBy("y").collect()] == [2, 1, 0]
    listed, present = mt.macro_f1(report).first(), mt.macro_f1(report, (), True).first()
    assert abs(listed.macro_f1 - 4 / 9) < 1e-12 and abs(present.macro_f1 - 2 / 3) < 1e-12
    assert rows(mt.confusion_matrix(df, 3), "y") == [(0, 1, 1, 0), (1, 0, 1, 0), (2, 0, 0, 0)]
    nodes = spark.createDataFrame(
        [("a", i % 2, i % 2, i / 4) for i in range(4)] + [("b", 0, 0, 0.1)], "slice_id string, y int, pred int, p double"
    )
    per_slice, pooled = mt.node_evaluation(nodes, ["n", "p"], binary=True)
    assert [(r.slice_id, r.macro_f1) for r in per_slice.collect()] == [("a", 1.0)]
    assert pooled.first().n == 4


def test_rollup_skips_undefined_metrics(spark):
    data = [("s1", "t", "strict", 5, 0.5, None, 0.1), ("s2", "t", "strict", 7, None, None, 0.3)]
    df = spark.createDataFrame(
        data, "slice_id string, target_sn string, closure string, n long, auroc double, auprc double, brier double"
    )
    assert rows(mt.target_rollup(df)) == [("t", "strict", 2, 12, 0.5, None, 0.2)]


def test_label_spaces(spark):
    df = spark.createDataFrame([(i,) for i in range(9)] + [(-100,), (None,)], "ccre_label int")
    expected = {"binary": "011111111", "group3": "021122222", "group4": "021132333", "group5": "021132334"}
    for scheme, digits in expected.items():
        classes = [int(c) for c in digits]
        got, names = lb.label_set(df, scheme)
        assert sorted(rows(got)) == sorted(enumerate(classes)) and max(classes) < len(names)
    some, _ = lb.label_set(df, "category-binary", "Promoter-Like")
    assert sorted(rows(some)) == [(0, 0), (1, 1), (5, 1)]
    assert lb.n_classes("4class") == 4 and lb.scheme_name("Binary-CCRE") == "binary"
    table = lb.scheme_table(spark)
    assert rows(table.filter("scheme = 'category:ca' and y = 1").select("element_class")) == [("CA",)]
    assert table.filter("scheme = 'group5'").count() == 9
    for bad in (lambda: lb.scheme_classes("six"), lambda: lb.category_label(F.lit(1), "zzz")):
        with pytest.raises(ValueError):
            bad()
    weights = lb.class_weights(spark.createDataFrame([(0,), (0,), (0,), (2,)], "y int"), ["a", "b", "c"])
    values = [r.weight for r in weights.orderBy("y").collect()]
    assert abs(sum(values) / 3 - 1) < 1e-12 and values[1] == max(values)


def test_splits(spark):
    good = sp.split_table(spark, train=["chr9"], val=["X#0#chr2", "chr2"], test=["chr4"])
    assert rows(good, "chrom") == [("chr2", "val"), ("chr4", "test"), ("chr9", "train")]
    sp.require_split(good, "train", "val")
    bad = sp.split_table(spark, val=["chr5", "chr6"], test=["a#chr6"])
    assert rows(sp.split_overlaps(bad)) == [("chr6", ["test", "val"])]
    assert rows(sp.shared_keys(good, bad, ["chrom"])) == []
    with pytest.raises(ValueError, match="chr6"):
        sp.require_split(bad)
    with pytest.raises(ValueError, match="train"):
        sp.require_split(sp.split_table(spark, val=["chr5"]), "train")
    with pytest.raises(ValueError, match="both"):
        sp.chrom_split(F.col("c"), ["chr1"], ["k#chr1"])
    edges = spark.createDataFrame([("a", i) for i in range(25)] + [("b", i) for i in range(13)], "slice_id string, k long")
    got = sp.slice_split(edges, ["k"]).groupBy("slice_id", "split").count()
    assert dict(((r[0], r[1]), r[2]) for r in got.collect()) == {
        ("a", "test"): 5, ("a", "val"): 2, ("a", "train"): 18,
        ("b", "test"): 2, ("b", "val"): 1, ("b", "train"): 10,
    }
    manifest = spark.createDataFrame([("x", "strict"), ("y", "1hop")], "slice_id string, closure string")
    assert sp.filter_manifest(manifest, "1hop", "test").first().slice_id == "y"
    assert rows(sp.filter_manifest(manifest, max_slices=1).select("slice_id")) == [("x",)]
    with pytest.raises(RuntimeError):
        sp.filter_manifest(manifest, "none")
    have = spark.createDataFrame([("c1",)], "SN string")
    with pytest.raises(ValueError, match="c2"):
        sp.require_targets(spark.createDataFrame([("c1",), ("c2",)], "SN string"), have)


def test_constant_features_and_unknown_sets(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    scaled = md.Standardizer(df, ["a", "b"]).transform(df)
    assert [list(r.features) for r in scaled.collect()] == [[-1.0, 0.0], [1.0, 0.0]]
    with pytest.raises(ValueError, match="feature set"):
        ft.feature_table(df, df, df, "nope")
    with pytest.raises(ValueError, match="method"):
        md.fit_classifier("nope", df, 1, 2)


@pytest.fixture(scope="module")
def separable(spark):
    rng = random.Random(6)
    data = []
    for i in range(600):
        y = int(rng.random() < 0.3)
        data.append((i, f"chr{1 + i % 3}", y, rng.gauss(2.5 * y, 1), rng.gauss(0, 1), ("train", "val", "test")[i % 3]))
    return spark.createDataFrame(data, "segid long, chrom string, y int, f1 double, f2 double, split string")


@pytest.mark.parametrize("method,options", [("logistic", {}), ("mlp", {"max_iter": 30}), ("random_forest", {"trees": 20})])
def test_classifiers_learn(separable, method, options):
    out = fit_and_report(separable, ["f1", "f2"], ["n", "p"], method, **options)
    report = {r.split: r for r in out["binary"].collect()}
    assert report["test"].auroc > 0.9 and report["val"].macro_f1 > 0.75
    assert out["predictions"].count() == 400 and out["confusion"].count() == 2
    assert out["label_counts"].count() == 4


def test_study_needs_two_labels_and_a_test_split(separable):
    with pytest.raises(RuntimeError, match="two labels"):
        fit_and_report(separable.filter("y = 1"), ["f1"], ["n", "p"], "logistic")
    with pytest.raises(RuntimeError, match="test split"):
        fit_and_report(separable.filter("split <> 'test'"), ["f1"], ["n", "p"], "logistic")


def test_logistic_strength_matches_the_summed_loss(spark):
    """At the optimum the gradient of C * summed weighted loss + |w|^2 / 2 is zero."""
    rng = random.Random(8)
    data = [(int(rng.random() < 0.5), rng.gauss(0, 1)) for _ in range(80)]
    df = spark.createDataFrame([(y, x + 0.7 * y) for y, x in data], "y int, a double")
    rows_ = md.Standardizer(df, ["a"]).transform(df)
    model = md.fit_logistic(rows_)
    weighted, _ = md.with_balanced_weights(rows_)
    scored = md.predict(model, weighted)
    x = df.withColumn("a", md.Standardizer(df, ["a"]).expressions()[0])
    slope = model.coefficients[0]
    counts = dict(rows(df.groupBy("y").count()))
    grad = slope
    for r in x.collect():
        p = 1 / (1 + 2.718281828459045 ** -(slope * r.a + model.intercept))
        grad += 80 / (2 * counts[r.y]) * (p - r.y) * r.a
    assert abs(grad) < 0.05 and scored.count() == 80


@pytest.mark.parametrize("balanced", [True, False])
def test_gradient_proves_an_optimum_and_shows_an_early_stop(spark, balanced):
    rng = random.Random(9)
    data = [(int(i % 3 == 0), rng.gauss(0, 1) + (i % 3 == 0), rng.gauss(0, 1)) for i in range(300)]
    df = spark.createDataFrame(data, "y int, a double, b double")
    rows_ = md.Standardizer(df, ["a", "b"]).transform(df)
    full = md.optimality(md.fit_logistic(rows_, balanced=balanced), rows_, balanced=balanced).first()
    early = md.optimality(
        md.fit_logistic(rows_, balanced=balanced, max_iter=1), rows_, balanced=balanced
    ).first()
    assert (full.n_train, full.n_pos) == (300, 100)
    assert full.max_gradient < 1e-6 < 1e-3 < early.max_gradient


def test_gradient_equals_a_plain_sum(spark):
    df = spark.createDataFrame([(0, -1.0), (0, 0.5), (1, 0.2), (1, 2.0)], "y int, a double")
    rows_ = md.Standardizer(df, ["a"]).transform(df)
    model = md.fit_logistic(rows_, balanced=False, max_iter=1)
    slope, shift = float(model.coefficients[0]), model.intercept
    points = [(r.y, float(r.features[0])) for r in rows_.collect()]
    rest = [(1 / (1 + math.exp(-(slope * x + shift))) - y, x) for y, x in points]
    want = max(abs(sum(e * x for e, x in rest) / 4 + slope / 4), abs(sum(e for e, _ in rest) / 4))
    assert abs(md.optimality(model, rows_, balanced=False).first().max_gradient - want) < 1e-12


def test_link_scores_by_contig_and_closure(spark):
    meta = spark.createDataFrame(
        [(o, "c1" if o < 20 else "c2", 10 * o, 5, 0, 1) for o in range(40)],
        "oid long, SN string, SO long, LN long, SR int, is_reference int",
    )
    degrees = spark.createDataFrame([(o, 1) for o in range(40)], "oid long, degree long")
    pairs = []
    for i in range(60):
        sn, closure, base = ("c1", "strict", 0) if i % 3 else ("c2", "1hop", 20)
        y = 1 if i % 2 and i % 3 else 0  # one label only in c2
        split = ("train", "test", "val")[(i // 6) % 3]
        pairs.append((sn, closure, base + i % 9, base + (i % 9) + (1 if y else 9), y, split))
    df = spark.createDataFrame(pairs, "target_sn string, closure string, u long, v long, y int, split string")
    got = score_links(df, meta, degrees, ["delta_so", "deg", "same_sn"])
    table = {(r.target_sn, r.closure): r for r in got.by_group.collect()}
    test_rows = [p for p in pairs if p[5] == "test"]
    assert table[("c1", "strict")].n_edges == sum(p[0] == "c1" for p in test_rows)
    assert table[("c1", "strict")].auroc == 1.0 and table[("c2", "1hop")].auroc is None
    assert got.overall.first().n_edges == got.predictions.count() == len(test_rows)
    assert got.certificate.first().n_train == sum(p[5] == "train" for p in pairs)


def test_projection_is_centred(spark):
    rng = random.Random(2)
    data = [(i, [rng.gauss(5, 3), rng.gauss(1, 1), rng.gauss(0, 0.1)]) for i in range(60)]
    out = md.project_two(spark.createDataFrame(data, "id int, x array<double>"), "x")
    m = out.agg(F.avg("pc1"), F.avg("pc2"), F.var_pop("pc1"), F.var_pop("pc2")).first()
    assert abs(m[0]) < 1e-9 and abs(m[1]) < 1e-9 and m[2] > m[3] > 0


def test_candidate_ranking(spark):
    index = spark.createDataFrame([(i, f"s{i}") for i in range(6)], "segid long, name string")
    scored = spark.createDataFrame(
        [("x", 0, 2, 0, 0.9), ("x", 2, 5, 0, 0.8), ("x", 4, 6, 0, 0.8), ("x", 0, 4, 1, 0.99)],
        "slice_id string, u long, v long, y int, p double",
    )
    other = spark.createDataFrame(
        [("s0", "+", "s1", "+"), ("s1", "+", "s2", "+")], "from_seg string, from_orient string, to_seg string, to_orient string"
    )
    found, best, precision, calibration = rk.imputation_summary(scored, index, rk.comparison_edges(other), 0, 2)
    flags = {(r.u_seg, r.v_orient): r.present_in_comparison for r in found.collect()}
    assert flags == {("s0", "+"): True, ("s1", "-"): False, ("s2", "+"): False}
    assert [(r.u, r.v) for r in best.collect()] == [(0, 2), (2, 5)]
    table = {r.k: (r.n_used, r.precision) for r in precision.collect()}
    assert table[2] == (2, 0.5) and table[10][0] == 3 and abs(table[None][1] - 1 / 3) < 1e-12
    assert calibration.first().n == 4
    nothing = rk.candidates(scored.filter("y = 7"), index, 0, rk.comparison_edges(other))
    assert nothing.count() == 0


@pytest.mark.parametrize("label", [0, 1])
@pytest.mark.parametrize("method,options", [("logistic", {}), ("mlp", {"max_iter": 5}), ("random_forest", {"trees": 3})])
def test_a_single_label_is_fitted_where_it_is_allowed(separable, label, method, options):
    """Elements that cover every segment leave one label in all splits."""
    out = fit_and_report(
        separable.withColumn("y", F.lit(label)), ["f1", "f2"], ["n", "p"], method, one_label=True, **options
    )
    counts = {(r.split, r.y): r.n for r in out["label_counts"].collect()}
    assert counts["train", 1 - label] == counts["test", 1 - label] == 0 < counts["train", label]
    assert {r.pred for r in out["predictions"].select("pred").distinct().collect()} == {label}
    assert all(r.auroc is None and r.positive_fraction == label for r in out["binary"].collect())
    if method == "logistic":
        proof = out["certificate"].first()
        assert proof.max_gradient < 1e-6 and proof.n_pos == label * proof.n_train


def test_slice_split_sorts_no_rows_but_those_at_its_marks(spark, monkeypatch):
    n = {"a": 40_000, "b": 13, "c": 7}
    edges = spark.createDataFrame([(s, k) for s, m in n.items() for k in range(m)], "slice_id string, k long")
    sorted_rows = []
    whole = sp.with_position

    def spy(df, *rest, **named):
        sorted_rows.append(df.count())
        return whole(df, *rest, **named)

    monkeypatch.setattr(sp, "with_position", spy)
    got = {(r.slice_id, r.k): r.split for r in sp.slice_split(edges, ["k"], 5).collect()}
    assert sum(sorted_rows) < 200
    want = {}
    for s, m in n.items():
        hashed = sorted((int(md5(f"5|{s}|{k}".encode()).hexdigest()[:15], 16), k) for k in range(m))
        test, val = math.floor(m * 0.2), math.floor(m * 0.1)
        for rank, (_, k) in enumerate(hashed):
            want[s, k] = "test" if rank < test else "val" if rank < test + val else "train"
    assert got == {k: v for k, v in want.items() if k[0] != "c"}
    # Without a row to train on, the last split ends the slice.
    ends = sp.slice_split(edges.filter("slice_id = 'b'"), ["k"], 5, 0.5, 0.5, min_train=0)
    assert ends.groupBy().pivot("split", ["test", "val", "train"]).count().first() == (6, 6, 1)
    assert sp.slice_split(edges.filter("slice_id = 'c'"), ["k"], 5, 1.0, 0.0, min_train=0).filter("split = 'test'").count() == 7


def test_link_scorer_gives_val_pairs_no_features_and_scores_on_demand(spark):
    meta = spark.createDataFrame(
        [(o, "c1", 10 * o, 5, 0, 1) for o in range(10)],
        "oid long, SN string, SO long, LN long, SR int, is_reference int",
    )
    degrees = spark.createDataFrame([(o, 1) for o in range(11)], "oid long, degree long")
    pairs = [("c1" if i % 4 else None, "strict", f"s{i % 3}", i % 9, 1 + i % 10, i % 2, ("train", "test", "val")[i % 3]) for i in range(60)]
    df = spark.createDataFrame(pairs, "target_sn string, closure string, slice_id string, u long, v long, y int, split string")
    got = score_links(df, meta, degrees, ["delta_so", "deg", "same_sn"])
    assert got.table.groupBy("split").count().count() == 2 and "predictions" not in vars(got)
    # A node without metadata keeps its degree.
    assert {r.deg for r in got.table.collect()} == {2} and got.table.filter("v = 10").count() > 0
    want = sorted((str(p[0]), *p[2:6]) for p in pairs if p[6] == "test")
    assert sorted((str(r.target_sn), r.slice_id, r.u, r.v, r.y) for r in got.predictions.collect()) == want


def test_best_candidates_names_the_best_edges_only(spark, monkeypatch):
    index = spark.range(60).selectExpr("id as segid", "concat('s', id) as name")
    rng = random.Random(3)
    data = [(rng.choice("ab"), rng.randrange(120), rng.randrange(120), i % 2, rng.randrange(50) / 50) for i in range(3_000)]
    scored = spark.createDataFrame(data, "slice_id string, u long, v long, y int, p double")
    links = scored.selectExpr(
        "concat('s', u div 2) as from_seg", "if(u % 2 = 0, '+', '-') as from_orient",
        "concat('s', v div 2) as to_seg", "if(v % 2 = 0, '+', '-') as to_orient", "y",
    )
    other = rk.comparison_edges(links.filter("y = 1 or from_orient = '+'"))
    named = []
    whole = rk._named
    monkeypatch.setattr(rk, "_named", lambda df, index: named.append(df.count()) or whole(df, index))
    want = rows(rk.top_candidates(rk.candidates(scored, index, 0, other), 40))
    named.clear()
    got = rk.best_candidates(scored, index, 0, other, 40)
    assert rows(got) == want and named == [40] and len({r[-1] for r in want}) == 2
    # Ends that the index does not know are no candidates; the next best take their place.
    few = index.filter("segid % 3 <> 0")
    want = rows(rk.top_candidates(rk.candidates(scored, few, 0, other), 40))
    assert rows(rk.best_candidates(scored, few, 0, other, 40)) == want and len(want) == 40
