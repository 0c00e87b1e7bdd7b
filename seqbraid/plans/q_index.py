"""Registered queries: parsing, ids, metadata, degrees, inspection."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbraid.functions.names import (
    contig_chrom,
    contigs_of_chroms,
    normalize_chrom,
    population_index,
    report_chrom,
    sample_id,
    targets_table,
)
from seqbraid.operators import index as ix
from seqbraid.operators import inspect as look
from seqbraid.plans.registry import query
from seqbraid.plans.views import GRAPH_SQL, SEGMENTS_SQL, graph, oracle, raw_links, raw_segments
from seqbraid.session import shared_dir
from seqbraid.sources import gfa
from seqbraid.streaming import gfa_stream

_texts: dict[tuple[str, str], str] = {}


def gfa_text(spark: SparkSession, sf_dir: str) -> str:
    """The graph written as GFA text: segments in id order, then links in link order.

    Every 7th segment lacks its SR tag and every 11th its SO tag.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _texts:
        g = graph(spark, sf_dir)
        tags = [
            F.concat(F.lit("LN:i:"), "LN"),
            F.concat(F.lit("SN:Z:"), "SN"),
            F.when(F.col("id") % 11 != 0, F.concat(F.lit("SO:i:"), "SO")),
            F.when(F.col("id") % 7 != 0, F.concat(F.lit("SR:i:"), "SR")),
        ]
        segs = g.segments.select(
            F.lit(0).alias("part"),
            F.col("segid").alias("n"),
            F.concat_ws("\t", F.lit("S"), "name", "seq", *tags).alias("value"),
        )
        fields = ["from_seg", "from_orient", "to_seg", "to_orient", "overlap"]
        # Their text needs no ids, so links are not looked up for it.
        found = g.links if g.has_links else raw_links(spark, sf_dir)
        links = found.select(
            F.lit(1).alias("part"),
            F.col("link_id").alias("n"),
            F.concat_ws("\t", F.lit("L"), *fields).alias("value"),
        )
        path = f"{shared_dir(spark)}/gfa-{spark.sparkContext.applicationId}-{len(_texts)}"
        segs.union(links).orderBy("part", "n").select("value").write.mode("overwrite").text(path)
        _texts[key] = path
    return _texts[key]


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gfa.split_records(gfa.read_lines(spark, gfa_text(spark, sf_dir)))


PARSED_SQL = """
parsed as (
  select segid, segid as id, name, seq, LN, SN, case when id % 11 = 0 then 0 else SO end as SO,
         cast(case when id % 7 = 0 then 0 else SR end as integer) as SR
  from seg_u)"""


@query("gfa_segments", oracle(SEGMENTS_SQL, PARSED_SQL, "select id, name, seq, LN, SN, SO, SR from parsed"))
def gfa_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gfa.read_segments(spark, gfa_text(spark, sf_dir))


@query(
    "gfa_stream_segments",
    oracle(SEGMENTS_SQL, PARSED_SQL, "select id, name, seq, LN, SN, SO, SR from parsed"),
)
def gfa_stream_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text arrives in three parts; the stream stops after each and starts again."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    lines = gfa.read_lines(spark, gfa_text(spark, sf_dir))
    part = F.floor(F.col("line_no") * 3 / lines.count())
    for k in range(3):
        arrived = lines.filter(part == k).orderBy("line_no").select("value")
        arrived.write.text(f"{folder}/in/part-{k}")
        gfa_stream.ingest_segments(spark, f"{folder}/in", f"{folder}/out", f"{folder}/mark")
    return spark.read.parquet(f"{folder}/out").drop("batch")


@query(
    "gfa_links",
    oracle(
        GRAPH_SQL,
        "select from_seg, from_orient, to_seg, to_orient, overlap, 0 as SR, '' as L1, '' as L2 from lk",
    ),
)
def gfa_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gfa.read_links(spark, gfa_text(spark, sf_dir))


@query(
    "gfa_stats",
    oracle(
        GRAPH_SQL,
        """select (select count(*) from seg_u) + (select count(*) from lk) as lines_read,
                  (select count(*) from seg_u) as segments, (select count(*) from lk) as links,
                  cast(0 as bigint) as paths, cast(0 as bigint) as walks,
                  cast(0 as bigint) as segments_missing_sn,
                  (select count(*) from seg_u where id % 11 = 0) as segments_missing_so,
                  (select count(*) from seg_u where id % 7 = 0) as segments_missing_sr""",
    ),
)
def gfa_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gfa.parse_stats(spark.read.text(gfa_text(spark, sf_dir)))


TARGETED_SQL = """
hit as (select name from parsed where SN = 'GRCh38#0#chr1'),
near as (select from_seg as a, to_seg as b from lk
         where from_seg in (select name from hit) or to_seg in (select name from hit)),
kept as (select name from hit union select a from near union select b from near)"""


@query(
    "gfa_targeted",
    oracle(
        GRAPH_SQL,
        PARSED_SQL,
        TARGETED_SQL,
        """select row_number() over (order by segid) - 1 as id, name, seq, LN, SN, SO, SR
           from parsed where name in (select name from kept)""",
    ),
)
def gfa_targeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = targets_table(spark, ["chr1"], "GRCh38#0")
    return gfa.targeted_tables(_records(spark, sf_dir), targets, True)[0]


@query(
    "gfa_targeted_links",
    oracle(
        GRAPH_SQL,
        PARSED_SQL,
        TARGETED_SQL,
        """select from_seg, from_orient, to_seg, to_orient, overlap, 0 as SR, '' as L1, '' as L2 from lk
           where from_seg in (select name from kept) and to_seg in (select name from kept)""",
    ),
)
def gfa_targeted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = targets_table(spark, ["chr1"], "GRCh38#0")
    return gfa.targeted_tables(_records(spark, sf_dir), targets, True)[1]


@query(
    "gfa_targeted_stats",
    oracle(
        GRAPH_SQL,
        PARSED_SQL,
        TARGETED_SQL,
        """select (select count(*) from seg_u) + (select count(*) from lk) as lines_read,
                  cast(0 as bigint) as paths, cast(0 as bigint) as walks,
                  (select count(*) from parsed where name in (select name from kept)) as segments,
                  (select count(*) from lk where from_seg in (select name from kept)
                     and to_seg in (select name from kept)) as links,
                  cast(0 as bigint) as segments_missing_sn,
                  (select count(*) from seg_u where id % 11 = 0 and name in (select name from kept))
                    as segments_missing_so,
                  (select count(*) from seg_u where id % 7 = 0 and name in (select name from kept))
                    as segments_missing_sr,
                  cast(1 as bigint) as target_sns, (select count(*) from hit) as target_segments,
                  (select count(*) from kept) as kept_segment_names, 1 as include_link_neighbors""",
    ),
)
def gfa_targeted_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.text(gfa_text(spark, sf_dir))
    targets = targets_table(spark, ["chr1"], "GRCh38#0")
    return gfa.targeted_stats(lines, gfa.split_records(lines), targets, True)


@query(
    "segid_index",
    oracle(
        SEGMENTS_SQL,
        """dup as (select id, name, LN from g_seg union all
                   select id + 10000000, name, LN + 1 from g_seg where id % 100 = 0),
           firsts as (select name, min(id) as id, arg_min(LN, id) as LN from dup group by name)""",
        "select row_number() over (order by id) - 1 as segid, id, name, LN from firsts",
    ),
)
def segid_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = raw_segments(spark, sf_dir).select("id", "name", "LN")
    again = segs.filter("id % 100 = 0").select(
        (F.col("id") + 10_000_000).alias("id"), "name", (F.col("LN") + 1).alias("LN")
    )
    return ix.segment_index(segs.unionByName(again)).select("segid", "id", "name", "LN")


@query("link_oids", oracle(GRAPH_SQL, "select link_id, from_id, to_id, u, v from lk"))
def link_oids(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = ix.map_links(raw_links(spark, sf_dir), graph(spark, sf_dir).segments)
    return mapped.select("link_id", "from_id", "to_id", "u", "v")


_PARTIAL = "part_seg as (select * from seg_u where id % 5 <> 0)"


@query(
    "known_links",
    oracle(
        GRAPH_SQL,
        _PARTIAL,
        """select link_id, from_seg, to_seg from lk
           where from_seg in (select name from part_seg) and to_seg in (select name from part_seg)""",
    ),
)
def known_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    kept = ix.known_links(g.links, g.segments.filter("id % 5 <> 0"))
    return kept.select("link_id", "from_seg", "to_seg")


@query(
    "unknown_endpoints",
    oracle(
        GRAPH_SQL,
        _PARTIAL,
        """select from_seg as name from lk union select to_seg from lk
           except select name from part_seg""",
    ),
)
def unknown_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return ix.unknown_endpoints(g.links, g.segments.filter("id % 5 <> 0"))


META_SQL = """
md as (
  select 2 * segid + bit as oid, SN, SO, LN, SR,
         case when SR = 0 or SN like 'GRCh38%' or SN like 'CHM13%' or SN like 'id=CHM13%'
              then 1 else 0 end as is_reference
  from seg_u, (values (0), (1)) b(bit))"""


@query("oid_meta", oracle(SEGMENTS_SQL, META_SQL, "select * from md"))
def oid_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.oriented_metadata(graph(spark, sf_dir).segments)


@query(
    "ref_flag",
    oracle(
        SEGMENTS_SQL,
        META_SQL,
        "select SN, is_reference, count(*) as n from md group by SN, is_reference",
    ),
)
def ref_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = ix.oriented_metadata(graph(spark, sf_dir).segments)
    return meta.groupBy("SN", "is_reference").agg(F.count("*").alias("n"))


DEGREE_SQL = """
ends as (select u as oid from lk union all select v from lk),
deg as (select oid, count(*) as degree from ends group by oid)"""


@query("oriented_degree", oracle(GRAPH_SQL, DEGREE_SQL, "select oid, degree from deg"))
def oriented_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.oriented_degree(graph(spark, sf_dir).links)


@query("oriented_nodes", oracle(GRAPH_SQL, DEGREE_SQL, "select oid from deg"))
def oriented_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.oriented_nodes(graph(spark, sf_dir).links)


@query("positive_pairs", oracle(GRAPH_SQL, "select distinct u, v from lk"))
def positive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.positive_pairs(graph(spark, sf_dir).links)


SEG_DEGREE_SQL = """
sdeg as (
  select s.segid, coalesce(d.degree, 0) as degree from seg_u s left join
    (select oid // 2 as segid, count(*) as degree from ends group by 1) d on d.segid = s.segid)"""


@query("segment_degree", oracle(GRAPH_SQL, DEGREE_SQL, SEG_DEGREE_SQL, "select segid, degree from sdeg"))
def segment_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return ix.segment_degree(g.links, g.segments)


@query(
    "inspect_endpoints",
    oracle(
        GRAPH_SQL,
        _PARTIAL,
        """all_ends as (select from_seg as name from lk union select to_seg from lk),
           gone as (select name from all_ends except select name from part_seg)""",
        """select (select count(*) from all_ends) as n_link_nodes, (select count(*) from gone) as n_missing,
                  round(100.0 * (select count(*) from gone) / (select count(*) from all_ends), 6)
                    as pct_missing,
                  (select string_agg(name, ',' order by name)
                     from (select name from gone order by name limit 5)) as missing_examples""",
    ),
)
def inspect_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    check = look.endpoint_check(g.segments.filter("id % 5 <> 0"), g.links)
    return check.withColumn("missing_examples", F.array_join("missing_examples", ",")).withColumn(
        "pct_missing", F.round("pct_missing", 6)
    )


@query(
    "inspect_contigs",
    oracle(
        SEGMENTS_SQL,
        "select SN, count(*) as n_segments from seg_u group by SN order by n_segments desc, SN limit 10",
    ),
)
def inspect_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look.contig_counts(graph(spark, sf_dir).segments)


@query(
    "inspect_ranks",
    oracle(
        SEGMENTS_SQL,
        "select SR, count(*) as n_segments from seg_u group by SR order by SR limit 20",
    ),
)
def inspect_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look.rank_counts(graph(spark, sf_dir).segments)


@query(
    "inspect_sizes",
    oracle(
        GRAPH_SQL,
        """select (select count(*) from seg_u) as n_segments,
                  (select count(distinct SN) from seg_u) as n_contigs,
                  (select count(*) from lk) as n_links""",
    ),
)
def inspect_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return look.table_sizes(g.segments, g.links)


@query(
    "target_autopick",
    oracle(
        SEGMENTS_SQL,
        """select SN, cast(cast(split_part(SN, 'chr', 2) as integer) - 1 as integer) as place
           from (select distinct SN from seg_u where SN like 'GRCh38%')""",
    ),
)
def target_autopick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look.auto_targets(graph(spark, sf_dir).segments)


@query(
    "target_autopick_frequent",
    oracle(
        SEGMENTS_SQL,
        """select SN, cast(row_number() over (order by n desc, SN) - 1 as integer) as place
           from (select SN, count(*) as n from seg_u where SN not like 'GRCh38%' group by SN)
           order by place limit 3""",
    ),
)
def target_autopick_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look.auto_targets(graph(spark, sf_dir).segments.filter("not startswith(SN, 'GRCh38')"))


@query(
    "contig_names",
    oracle(
        SEGMENTS_SQL,
        """select distinct SN, split_part(SN, '#', 3) as chrom, split_part(SN, '#', 3) as short_chrom,
                  split_part(SN, '#', 3) as norm_chrom, split_part(SN, '#', 1) as sample
           from seg_u""",
    ),
)
def contig_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    sn = F.col("SN")
    return (
        graph(spark, sf_dir)
        .segments.select("SN")
        .distinct()
        .select(
            "SN",
            contig_chrom(sn).alias("chrom"),
            report_chrom(sn).alias("short_chrom"),
            normalize_chrom(sn).alias("norm_chrom"),
            sample_id(sn).alias("sample"),
        )
    )


@query(
    "contigs_of_chroms",
    oracle(
        SEGMENTS_SQL,
        """select distinct SN, split_part(SN, '#', 3) as chrom from seg_u
           where SN like 'GRCh38%' and split_part(SN, '#', 3) in ('chr1', 'chr3')""",
    ),
)
def contigs_on_chroms(spark: SparkSession, sf_dir: str) -> DataFrame:
    chroms = targets_table(spark, ["chr1", "chr3"]).withColumnRenamed("SN", "chrom")
    return contigs_of_chroms(graph(spark, sf_dir).segments, chroms)


@query(
    "pop_index",
    oracle(
        SEGMENTS_SQL,
        """select segid, SN, cast(case when SN like 'GRCh38%' then 6
                  when split_part(SN, '#', 1) = 'HG009' then 5
                  else cast(substr(split_part(SN, '#', 1), 5) as integer) % 5 end as integer) as pop_idx
           from seg_u""",
    ),
)
def pop_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = graph(spark, sf_dir).segments
    samples = segments.select(sample_id(F.col("SN")).alias("sample_id")).distinct()
    table = samples.filter("sample_id like 'HG00%' and sample_id <> 'HG009'").select(
        "sample_id", (F.substring("sample_id", 5, 1).cast("int") % 5).alias("pop_idx")
    )
    return population_index(segments.select("segid", "SN"), table)
