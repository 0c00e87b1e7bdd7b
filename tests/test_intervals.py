from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from frames import rows
from seqbraid.operators import intervals as iv
from seqbraid.schemas import ELEMENT_CLASSES, ELEMENT_PRIORITY

BED = "chrom string, start long, end long, cCRE_acc string, cCRE_class string"
IDX = "segid long, name string, SN string, SO long, LN long, SR int"


def _index(spark, spans, sn="GRCh38#0#chr1"):
    data = [(i, f"s{i}", sn, so, ln, 0) for i, (so, ln) in enumerate(spans)]
    return spark.createDataFrame(data, IDX)


def test_dominant_class_rules(spark):
    index = _index(spark, [(0, 20), (10, 0), (100, 10), (200, 5)]).union(
        spark.createDataFrame([(9, "alt", "HG1#1#chr1", 0, 20, 1), (8, "other", "GRCh38#0#chr9", 0, 20, 0)], IDX)
    )
    bed = spark.createDataFrame(
        [
            ("chr1", 0, 10, "a", "CA"),
            ("chr1", 10, 20, "b", "PLS"),
            ("chr1", 100, 106, "c", "dELS"),
            ("chr1", 100, 106, "d", "dELS"),
            ("chr1", 100, 110, "e", "TF"),
            ("chr1", 202, 202, "f", "PLS"),
        ],
        BED,
    )
    got = {r.segid: r for r in iv.node_labels(bed, index).collect()}
    assert set(got) == {0, 1, 2, 3}  # other assemblies and uncovered chromosomes are left out
    assert (got[0].ccre_class, got[0].overlap_bp, got[0].n_ccres_touching) == ("PLS", 20, 2)
    assert (got[1].ccre_class, got[1].overlap_bp) == ("background", 0)  # zero length
    # Two intervals of one class add up, 12 of 10 bases.
    assert (got[2].ccre_class, got[2].dominant_class_overlap_bp, got[2].overlap_bp) == ("dELS", 12, 22)
    assert (got[3].ccre_class, got[3].ccre_label, got[3].oid_rev) == ("background", 0, 7)
    table = iv.class_crosstab(iv.node_labels(bed, index)).first()
    assert table["TOTAL"] == 4 and table["CA"] == 0 and table["background"] == 2


def test_random_overlaps_match_brute_force(spark):
    rng = random.Random(5)
    classes = ELEMENT_CLASSES[1:]
    spans = [(rng.randrange(300), rng.choice([0, 1, 5, 40, 250])) for _ in range(120)]
    # A third of all intervals pile up on one spot.
    bed = [
        ("chr1", 50, 60, f"E{i}", rng.choice(classes))
        if i % 3 == 0
        else ("chr1", s := rng.randrange(300), s + rng.randrange(0, 90), f"E{i}", rng.choice(classes))
        for i in range(150)
    ]
    index, intervals = _index(spark, spans), spark.createDataFrame(bed, BED)
    got = {r.segid: r for r in iv.node_labels(intervals, index).collect()}
    for i, (so, ln) in enumerate(spans):
        bp: dict[str, int] = {}
        for _, s, e, _, c in bed:
            shared = min(e, so + ln) - max(s, so)
            if shared > 0:
                bp[c] = bp.get(c, 0) + shared
        best = max(bp, key=lambda c: (bp[c], ELEMENT_PRIORITY[c])) if bp else "background"
        row = got[i]
        assert (row.ccre_class, row.overlap_bp, row.n_ccres_touching) == (best, sum(bp.values()), len(bp))
    pairs = iv.class_overlaps(intervals, iv.reference_segments(index, intervals))
    assert pairs.agg(F.sum("overlap_bp")).first()[0] == sum(r.overlap_bp for r in got.values())


@pytest.mark.parametrize("width,rows_per_bin", [(7, 10**6), (1000, 10**6), (50, 3)])
def test_windows_and_pairs_match_the_predicate(spark, width, rows_per_bin):
    rng = random.Random(9)
    spans = [(rng.randrange(-20, 200), rng.choice([0, 0, 3, 90])) for _ in range(80)]
    wins = [(f"w{i}", "GRCh38#0#chr1", s := rng.randrange(-40, 200), s + 20) for i in range(25)]
    index = _index(spark, spans)
    windows = spark.createDataFrame(wins, "slice_id string, target_sn string, start long, end long")
    want = sorted(
        (w, i) for w, _, a, b in wins for i, (so, ln) in enumerate(spans) if so < b and so + ln > a
    )
    assert sorted(rows(iv.window_core(windows, index, width, rows_per_bin))) == want
    counts = dict(rows(iv.overlap_counts(windows.withColumnRenamed("slice_id", "window_id"), index)))
    assert counts == {w[0]: sum(1 for x, _ in want if x == w[0]) for w in wins}


def test_no_rows_is_an_error(spark):
    bed = spark.createDataFrame([("chrZ", 0, 9, "a", "CA")], BED)
    with pytest.raises(RuntimeError):
        iv.require_rows(iv.node_labels(bed, _index(spark, [(0, 5)])))


@pytest.mark.parametrize("bin_rows", [10**6, 20])
def test_pairs_of_intervals_of_every_length(spark, bin_rows):
    rng = random.Random(4)
    def draw(n):
        out = [(rng.choice("ab"), s, s + int(rng.paretovariate(0.3)) % 10**6) for s in (rng.randrange(-500, 10**5) for _ in range(n))]
        return out + [("a", 50, 90)] * 40 + [("a", 4096, 4096), ("b", -10**7, 10**9), ("a", 8, 8)]
    left = [(i, *r) for i, r in enumerate(draw(150))]
    right = [(i, *r) for i, r in enumerate(draw(150))]
    a = spark.createDataFrame(left, "i long, chrom string, start long, end long")
    b = spark.createDataFrame(right, "j long, chrom string, start long, end long")
    got = rows(iv.overlap_pairs(a, b, ["chrom"], 16, bin_rows).select("i", "j"))
    want = [(i, j) for i, c, s, e in left for j, d, x, y in right if c == d and s < y and e > x]
    assert sorted(got) == sorted(want) and len(want) > 2000


def test_an_interval_stands_in_two_bins_however_long(spark):
    long = spark.createDataFrame([(0, 3 * 10**9)], "start long, end long")
    own = iv._level(F.col("start"), F.col("end"), iv.BIN_WIDTH)
    assert iv._in_bins(long, "start", "end", F.array(own), iv.BIN_WIDTH).count() == 1
    pile = spark.range(200_000).selectExpr("'c' as chrom", "1000 + id % 50 as start", "1100 + id % 50 as end")
    whole = spark.createDataFrame([("c", 0, 3 * 10**9)], "chrom string, start long, end long")
    assert iv.overlap_pairs(pile, whole, ["chrom"], bin_rows=10_000).count() == 200_000


def test_tasks_share_the_pairs_of_one_spot(spark):
    """Few bytes go into the join of one bin, many pairs come out."""
    a = spark.range(2000).select(F.lit("c").alias("chrom"), F.col("id").alias("i"), F.lit(0).cast("long").alias("start"), F.lit(9).cast("long").alias("end"))
    b = a.select("chrom", F.col("i").alias("j"), "start", "end")
    got = iv.overlap_pairs(a, b, ["chrom"], bin_pairs=100_000)
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 4_000_000 and max(tasks) < 800_000


@pytest.mark.parametrize("n, m", [(2000, 2000), (100, 4000), (4000, 3)])
def test_rows_of_a_hot_spot_are_repeated_by_the_root_of_its_pairs(spark, monkeypatch, n, m):
    a = spark.range(n).selectExpr("'c' as chrom", "id as i", "0L as start", "9L as end")
    b = spark.range(m).selectExpr("'c' as chrom", "id as j", "0L as start", "9L as end")
    moved = []
    whole = iv._pieces

    def spy(*given):
        moved.append(whole(*given).count())
        return whole(*given)

    monkeypatch.setattr(iv, "_pieces", spy)
    got = iv.overlap_pairs(a, b, ["chrom"], bin_pairs=2_000)
    assert got.select("i", "j").distinct().count() == got.count() == n * m
    assert sum(moved) <= 2 * (n + m) + 3 * (n * m) / 2_000**0.5


def test_a_little_longer_than_a_bin_is_compared_on_bins_little_wider(spark):
    """Intervals of 1.2 bins meet those of the two bins around them, not of eight."""
    own = spark.createDataFrame([(0, iv.BIN_WIDTH * 6 // 5)], "start long, end long")
    level = own.select(iv._level(F.col("start"), F.col("end"), iv.BIN_WIDTH)).first()[0]
    assert iv.BIN_WIDTH * iv.BIN_STEP**level < 3 * iv.BIN_WIDTH
