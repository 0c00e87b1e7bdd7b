from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frames import rows
from seqbraid.functions import names as nm
from seqbraid.functions.vectors import adaptive_window, pair_interaction
from seqbraid.schemas import CANONICAL_CHROMS
from seqbraid.sources import population, tables


def test_targets(spark):
    def named(names, prefix=None):
        return [r.SN for r in nm.targets_table(spark, names, prefix).collect()]

    assert named(["chr5", "chrX"], "HG7#1") == ["HG7#1#chr5", "HG7#1#chrX"]
    assert named(["chr5"], "HG7|") == ["HG7|chr5"] and named(["chr5"], "a/{}.b") == ["a/chr5.b"]
    assert named(["chr5", "own#1#ctg", "id=K|z"]) == ["chr5", "own#1#ctg", "id=K|z"]
    assert named(["own#1#ctg", "id=K|z"], "HG7") == ["own#1#ctg", "id=K|z"]
    assert named(["Canonical"], "HG7") == [f"HG7#{c}" for c in CANONICAL_CHROMS]
    assert len(named(["ccre-paper", "chr5"])) == 5


def test_contig_expressions(spark):
    cases = {
        "chr7": ("chr7", "chr7", "chr7", "chr7", 0),
        "GRCh38#0#chr7": ("chr7", "chr7", "chr7", "GRCh38", 1),
        "id=CHM13|chr7": (None, "id=CHM13|chr7", "chr7", "id=CHM13|chr7", 1),
        "CHM13#0#chr7": ("chr7", "chr7", "chr7", "CHM13", 1),
        "HG002.1.chr7": (None, "HG002.1.chr7", "HG002.1.chr7", "HG002", 0),
        "HG2#1#ctg": (None, "ctg", "ctg", "HG2", 0),
    }
    sn = F.col("SN")
    df = spark.createDataFrame([(k,) for k in cases], "SN string").select(
        "SN",
        nm.contig_chrom(sn),
        nm.normalize_chrom(sn),
        nm.report_chrom(sn),
        nm.sample_id(sn),
        nm.is_reference(F.lit(3), sn),
    )
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == cases


def test_population_keeps_both_chm13_spellings_apart(spark):
    contigs = [("CHM13#0#chr1",), ("id=CHM13|chr1",), ("HG1#1#chr1",), ("HG9#1#chr1",), ("GRCh38#0#chr1",)]
    lookup = spark.createDataFrame([("HG1", 3), ("GRCh38", 0)], "sample_id string, pop_idx int")
    out = nm.population_index(spark.createDataFrame(contigs, "SN string"), lookup)
    assert dict(rows(out)) == {
        "CHM13#0#chr1": 6,
        "id=CHM13|chr1": 5,
        "HG1#1#chr1": 3,
        "HG9#1#chr1": 5,
        "GRCh38#0#chr1": 6,
    }


def test_small_expressions(spark):
    one = spark.range(1)
    name = nm.slice_name(F.lit("GRCh38#0#chr1"), F.lit(-5), F.lit(10), F.lit("strict"))
    assert one.select(name).first()[0] == "slice_GRCh38_0_chr1_-5_10_strict"
    windows = [("c" * 115, 0), ("c" * 115, 1), ("a#1", 0), ("a_1", 0), ("a 1", 0)]
    keys = [nm.slice_id(F.lit(t), F.lit(s), F.lit(9), F.lit("strict")) for t, s in windows]
    assert len(set(one.select(*keys).first())) == len(windows)
    labels = [nm.segid_from_label(F.lit(x)) for x in ("s12", "7", "x3", "s")]
    assert tuple(one.select(*labels).first()) == (12, 7, None, None)
    sizes = [adaptive_window(F.lit(b)) for b in (0.0, 0.37, 5.0)]
    assert tuple(one.select(*sizes).first()) == (32, 79, 256)
    pair = pair_interaction(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(-1.0)))
    assert one.select(pair).first()[0] == [1.0, 2.0, 3.0, -1.0, 3.0, -2.0, 2.0, 3.0]


def test_dataset_folder(spark, tmp_path):
    folder = tmp_path / "demo"
    folder.mkdir()
    with pytest.raises(FileNotFoundError, match="full_segments"):
        tables.find_dataset(spark, str(folder))
    (folder / "full_segments.csv").write_text("id,name,seq,LN,SN,SO,SR\n0,NA,*,4,,0,1\n")
    (folder / "full_links.csv").write_text("from_seg,from_orient,to_seg,overlap\n")
    found = tables.find_dataset(spark, str(folder))
    assert found["name"] == "demo" and found["benchmark_dir"].endswith("demo/benchmark")
    report = {r.table: r for r in tables.check_dataset(spark, str(folder)).collect()}
    assert report["segments"].ok and report["links"].missing == ["to_orient"]
    segs = tables.read_segments(spark, found["segments"])
    assert segs.first().name == "NA" and dict(segs.dtypes)["LN"] == "bigint"
    with pytest.raises(ValueError, match="to_orient"):
        tables.read_links(spark, found["links"])


def test_file_choice_order(spark, tmp_path):
    head = "id,name,seq,LN,SN,SO,SR\n"
    (tmp_path / "my_seg_table.csv").write_text(head)
    (tmp_path / "segments.csv").write_text("id,name\n")
    assert tables.choose_file(spark, str(tmp_path), "segments").endswith("my_seg_table.csv")
    (tmp_path / "segments_parsed.csv").write_text(head)
    assert tables.choose_file(spark, str(tmp_path), "segments").endswith("segments_parsed.csv")
    with pytest.raises(ValueError, match="segments.csv"):
        tables.choose_file(spark, str(tmp_path), "segments", "segments.csv")
    with pytest.raises(FileNotFoundError):
        tables.choose_file(spark, str(tmp_path), "links")


def test_bed_rejects_unknown_class(spark, tmp_path):
    good, bad = tmp_path / "a.bed", tmp_path / "b.bed"
    good.write_text("chr1\t5\t9\tE1\tR1\tPLS\n")
    bad.write_text("chr1\t5\t9\tE1\tR1\tnope\n")
    assert rows(tables.read_intervals(spark, str(good))) == [("chr1", 5, 9, "E1", "R1", "PLS")]
    with pytest.raises(ValueError, match="nope"):
        tables.read_intervals(spark, str(bad))


def test_population_file(spark, tmp_path):
    path = tmp_path / "pop.csv"
    path.write_text("Sample,Pop\nHG1,eur\nHG2,xyz\n ,AFR\nHG1,AFR\n")
    assert dict(rows(population.read_populations(spark, str(path)))) == {"HG1": 0, "HG2": 5}
    path.write_text("Sample\tOther\nHG1\teur\n")
    with pytest.raises(ValueError, match="superpopulation"):
        population.read_populations(spark, str(path))


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    tables.write_gz_csv(df, str(tmp_path / "c"))
    back = spark.read.schema(df.schema).option("header", True).csv(str(tmp_path / "c"))
    assert sorted(rows(back)) == sorted(rows(df))
    tables.write_json(df, str(tmp_path / "j"))
    schema = T.StructType(df.schema.fields)
    assert sorted(rows(tables.read_json(spark, str(tmp_path / "j"), schema))) == sorted(rows(df))


def test_slice_sink_and_complete_slices(spark, tmp_path):
    manifest = spark.createDataFrame(
        [("x", "strict", "c1"), ("y", "1hop", "c2")], "slice_id string, closure string, target_sn string"
    )
    both = spark.createDataFrame([("x", 1), ("y", 2)], "slice_id string, v int")
    parts = {"slice_segments": both, "slice_links": both, "slice_edge_pred": both.filter("v = 1")}
    tables.write_slices(parts, manifest, str(tmp_path / "s"))
    back = tables.read_slices(spark, str(tmp_path / "s"))
    assert rows(tables.complete_slices(back)) == [("x",)]
    assert back["slice_links"].filter("closure = '1hop'").count() == 1
