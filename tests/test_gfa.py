from __future__ import annotations

import gzip
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from frames import rows
from seqbraid.plans import q_index
from seqbraid.sources import gfa
from seqbraid.streaming import gfa_stream

FULL = "\n".join(
    [
        "# a comment",
        "H\tVN:Z:1.0",
        "S\ta1\tACGTA\tLN:i:5\tSN:Z:GRCh38#0#chr2\tSO:i:7\tSR:i:0",
        "S\ta2\tGG\tSN:Z:first\tSN:Z:last:with:colons\tSO:i:x\tSR:i:",
        "S\ta3\t*",
        "S\tshort",
        "L\ta1\t+\ta2\t-\t0M\tSR:i:4\tL1:Z:p:q",
        "L\ta1\t+\ta2",
        "P\tp\ta1+,a2+\t0M",
        "W\tw",
    ]
) + "\n"


@pytest.fixture
def full(spark, tmp_path):
    path = tmp_path / "full.gfa"
    path.write_text(FULL)
    return gfa.read_lines(spark, str(path))


def test_full_parse_tables(full):
    records = gfa.split_records(full)
    segs = gfa.segments_of(records)
    assert segs.columns == ["id", "name", "seq", "LN", "SN", "SO", "SR"]
    assert rows(segs, "id") == [
        (0, "a1", "ACGTA", 5, "GRCh38#0#chr2", 7, 0),
        (1, "a2", "GG", 2, "last:with:colons", 0, 0),
        (2, "a3", "*", 0, "", 0, 0),
    ]
    links = gfa.links_of(records).drop("line_no")
    assert links.columns == ["from_seg", "from_orient", "to_seg", "to_orient", "overlap", "SR", "L1", "L2"]
    assert rows(links) == [("a1", "+", "a2", "-", "0M", 4, "p:q", "")]


def test_parse_stats_count_comment_lines_and_missing_tags(full):
    assert gfa.parse_stats(full).first().asDict() == {
        "lines_read": 10,
        "segments": 3,
        "links": 1,
        "paths": 1,
        "walks": 1,
        "segments_missing_sn": 1,
        "segments_missing_so": 1,
        "segments_missing_sr": 1,
    }


def test_line_limit_takes_first_physical_lines(spark, tmp_path):
    path = tmp_path / "g.gfa"
    path.write_text(FULL)
    stats = gfa.parse_stats(gfa.read_lines(spark, str(path), max_lines=4)).first()
    assert (stats.lines_read, stats.segments, stats.links) == (4, 2, 0)


def test_gzip_text_reads_the_same(spark, tmp_path):
    path = tmp_path / "g.gfa.gz"
    with gzip.open(path, "wt") as fh:
        fh.write(FULL)
    lines = gfa.read_lines(spark, str(path))
    assert [r[0] for r in rows(lines.select("line_no"), "line_no")] == list(range(10))
    assert gfa.parse_stats(lines).first().segments == 3
    assert [r[1] for r in rows(gfa.read_segments(spark, str(path)), "id")] == ["a1", "a2", "a3"]
    assert gfa.read_links(spark, str(path)).count() == 1


def test_line_numbers_cross_file_blocks(spark, tmp_path):
    path = tmp_path / "big.gfa"
    path.write_text("".join(f"S\tn{i:05d}\tA\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        segs = gfa.segments_of(gfa.split_records(gfa.read_lines(spark, str(path))))
        assert sorted(rows(gfa.read_segments(spark, str(path)))) == sorted(rows(segs))
        wrong = segs.filter(F.concat(F.lit("n"), F.lpad("id", 5, "0")) != F.col("name"))
        assert wrong.count() == 0 and segs.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_numbers_do_not_depend_on_the_splits(spark, tmp_path):
    """Each scan is numbered from its own copy, so any two ways to cut a file agree."""
    path = tmp_path / "cut.gfa"
    path.write_text("".join(f"S\tn{i}\t{'A' * (i % 90)}\n" for i in range(3000)))
    seen = []
    try:
        for size in ("4096", "50000", "100000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            seen.append(gfa.read_lines(spark, str(path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({tuple(sorted(rows(lines))) for lines in seen}) == 1
    assert sorted(r.line_no for r in seen[0].collect()) == list(range(3000))


def test_targeted_parse_shuffles_no_sequence(spark, tmp_path):
    path = tmp_path / "t.gfa"
    path.write_text(TARGETED)
    records = gfa.split_records(gfa.read_lines(spark, str(path)))
    targets = spark.createDataFrame([("id=CHM13|chr22",)], "SN string")
    segments, _ = gfa.targeted_tables(records, targets, True)
    assert "Exchange hashpartitioning" not in segments._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("text,value", [("12", 12), (" 12 ", 12), ("-3", -3), ("1.5", 9), ("", 9), (None, 9), ("z", 9)])
def test_integer_coercion(spark, text, value):
    df = spark.createDataFrame([(text,)], "x string").select(gfa.to_int(F.col("x"), 9).alias("v"))
    assert df.first().v == value


TARGETED = "\n".join(
    [
        "S\tmain\tACGT\tSN:Z:id=CHM13|chr22\tSO:i:10\tSR:i:0",
        "S\tside\tTT\tSN:Z:HG001#1#chr22\tSR:i:1",
        "S\tfar\tGG\tSN:Z:id=CHM13|chr1\tSR:i:0",
        "S\talone\tGG\tSN:Z:id=CHM13|chr1\tSR:i:0",
        "L\tmain\t+\tside\t+\t0M",
        "L\tfar\t+\tmain\t+\t0M",
        "L\tside\t+\tfar\t+\t0M",
        "L\tfar\t+\talone\t+\t0M",
    ]
)


@pytest.mark.parametrize("near,names,links", [(True, ["far", "main", "side"], 3), (False, ["main"], 0)])
def test_targeted_parse(spark, tmp_path, near, names, links):
    path = tmp_path / "t.gfa"
    path.write_text(TARGETED)
    lines = gfa.read_lines(spark, str(path))
    records = gfa.split_records(lines)
    targets = spark.createDataFrame([("id=CHM13|chr22",)], "SN string")
    _, kept, kept_records = gfa.targeted_records(records, targets, near)
    assert [r[0] for r in rows(kept, "name")] == names
    segs = gfa.segments_of(kept_records)
    assert [r[0] for r in rows(segs.select("id"), "id")] == list(range(len(names)))
    assert gfa.links_of(kept_records).count() == links
    own, joined = gfa.targeted_tables(records, targets, near)
    assert sorted(rows(own)) == sorted(rows(segs)) and joined.count() == links
    assert "seq" in own.columns and {"overlap", "SR", "L1", "L2"} <= set(joined.columns)
    stats = gfa.targeted_stats(lines, records, targets, near).first()
    assert (stats.target_segments, stats.kept_segment_names, stats.links) == (1, len(names), links)
    assert stats.lines_read == 8


def test_round_trip_to_text(spark, full):
    records = gfa.split_records(full)
    segs, links = gfa.segments_of(records), gfa.links_of(records)
    again = gfa.to_gfa_lines(segs, links).withColumn("line_no", F.monotonically_increasing_id())
    back = gfa.segments_of(gfa.split_records(again)).drop("id")
    assert sorted(rows(back)) == sorted(rows(segs.drop("id")))


def test_stream_appends_new_files(spark, tmp_path):
    folder, out, mark = (tmp_path / n for n in ("in", "out", "mark"))
    folder.mkdir()
    for name, text in (("a.gfa", FULL), ("b.gfa", TARGETED)):
        (folder / name).write_text(text)
        segs = gfa_stream.stream_segments(gfa_stream.stream_records(spark, str(folder)))
        gfa_stream.append_parquet(segs, str(out), str(mark)).awaitTermination()
    assert spark.read.parquet(str(out)).count() == 3 + 4
    links = gfa_stream.stream_links(gfa_stream.stream_records(spark, str(folder)))
    gfa_stream.append_parquet(links, str(out) + "l", str(mark) + "l").awaitTermination()
    assert spark.read.parquet(str(out) + "l").count() == 1 + 4


def test_ingest_numbers_go_on_and_a_broken_batch_is_replaced(spark, tmp_path):
    folder, out, mark = (tmp_path / n for n in ("in", "out", "mark"))
    folder.mkdir()
    for number, (name, text) in enumerate((("a.gfa", FULL), ("b.gfa", TARGETED))):
        (folder / name).write_text(text)
        if number:
            # What an interrupted run left behind under the number of the next batch.
            spark.read.parquet(str(out / "batch=0")).write.parquet(str(out / "batch=1"))
        gfa_stream.ingest_segments(spark, str(folder), str(out), str(mark))
    gfa_stream.ingest_segments(spark, str(folder), str(out), str(mark))
    found = rows(spark.read.parquet(str(out)).select("id", "name"), "id")
    assert found == list(enumerate(["a1", "a2", "a3", "main", "side", "far", "alone"]))


def test_stream_numbers_do_not_follow_modification_times(spark, monkeypatch):
    """Four files a part; the later one along the text has the earlier time."""
    contract.queries()
    ingest = q_index.gfa_stream.ingest_segments

    def backdated(session, folder, *rest):
        files = sorted(Path(folder).rglob("part-*.txt"))
        for n, file in enumerate(files):
            if file.stat().st_mtime > 1_600_000_000:
                at = 1_500_000_000 + 10_000 * len(files) - n
                os.utime(file, (at, at))
        return ingest(session, folder, *rest)

    monkeypatch.setattr(q_index.gfa_stream, "ingest_segments", backdated)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sf_dir = "/root/testdata/sf0.001"
        found = rows(q_index.gfa_stream_segments(spark, sf_dir).select("id", "name"), "id")
        assert found == rows(q_index.graph(spark, sf_dir).segments.select("segid", "name"), "segid")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_targeted_stats_need_no_line_numbers(spark, tmp_path):
    """Lines as read, with a comment, a link to an unknown name and a segment without tags."""
    path = tmp_path / "t.gfa"
    path.write_text(TARGETED + "\n#c\nS\tbare\tA\nL\tmain\t+\tlost\t-\t0M\nL\tbare\t+\tmain\t-\t0M\n")
    lines = spark.read.text(str(path))
    targets = spark.createDataFrame([("id=CHM13|chr22",)], "SN string")
    found = gfa.targeted_stats(lines, gfa.split_records(lines), targets, True).first().asDict()
    assert found == {
        "lines_read": 12, "paths": 0, "walks": 0, "segments": 4, "links": 5, "segments_missing_sn": 1,
        "segments_missing_so": 3, "segments_missing_sr": 1, "target_sns": 1, "target_segments": 1,
        "kept_segment_names": 5, "include_link_neighbors": 1,
    }
