"""Sources, sinks and small table filters: the views are written, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbraid.operators import features as ft
from seqbraid.operators import intervals as iv
from seqbraid.operators import splits as sp
from seqbraid.plans.q_intervals import labels
from seqbraid.plans.q_slices import ONE_HOP_SQL, STRICT_SQL, slices
from seqbraid.plans.registry import query
from seqbraid.plans.views import (
    GRAPH_SQL,
    INTERVALS_SQL,
    SEGMENTS_SQL,
    graph,
    intervals,
    oracle,
    raw_links,
    raw_segments,
    read,
)
from seqbraid.schemas import SEGMENTS
from seqbraid.session import shared_dir
from seqbraid.sources import gfa, population, tables


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


# A contig name that is empty, and one that reads NA, must come back as they are.
_MARKED = "case when id % 13 = 0 then '' when id % 17 = 0 then 'NA' else SN end"
_SEGMENT_COLUMNS = ["id", "name", "seq", "LN", "SN", "SO", "SR"]


def _marked_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_segments(spark, sf_dir).withColumn("SN", F.expr(_MARKED)).select(*_SEGMENT_COLUMNS)


_MARKED_SQL = f"select id, name, seq, LN, {_MARKED} as SN, SO, SR from g_seg"


@query("csv_segments", oracle(SEGMENTS_SQL, _MARKED_SQL))
def csv_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    tables.write_gz_csv(_marked_segments(spark, sf_dir), path)
    return tables.read_segments(spark, path)


@query(
    "csv_links",
    oracle(GRAPH_SQL, "select from_seg, from_orient, to_seg, to_orient, overlap from g_link"),
)
def csv_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    tables.write_gz_csv(raw_links(spark, sf_dir).drop("link_id"), path)
    return tables.read_links(spark, path)


@query("json_segments", oracle(SEGMENTS_SQL, _MARKED_SQL))
def json_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    tables.write_json(_marked_segments(spark, sf_dir), path)
    return tables.read_json(spark, path, SEGMENTS)


@query("bed_intervals", oracle(INTERVALS_SQL, "select * from g_bed"))
def bed_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    intervals(spark, sf_dir).write.option("sep", "\t").csv(path)
    return tables.read_intervals(spark, path)


@query(
    "population_table",
    """select concat('HG', c_custkey) as sample_id,
              cast(case c_custkey % 5 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 3
                   else 5 end as integer) as pop_idx
       from customer""",
)
def population_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text table with two header spellings, padding, and labels outside the list."""
    path = _folder(spark)
    names = F.array(*map(F.lit, [" afr", "AMR", "eas ", "EUR", "nowhere"]))
    key = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(
        F.concat_ws(
            "\t", F.concat(F.lit(" HG"), key), F.lit("x"), F.get(names, (key % 5).cast("int"))
        ).alias("value")
    )
    header = spark.createDataFrame([("Sample\tother\tSuper_Pop",)], "value string")
    header.unionByName(rows).coalesce(1).write.text(path)
    return population.read_populations(spark, path)


@query("gfa_line_limit", oracle(SEGMENTS_SQL, "select segid as line_no, name from seg_u where segid < 777"))
def gfa_line_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    lines = gfa.to_gfa_lines(
        raw_segments(spark, sf_dir).orderBy("id"), raw_links(spark, sf_dir).limit(0)
    )
    lines.coalesce(1).write.text(path)
    kept = gfa.read_lines(spark, path, 777)
    return kept.select("line_no", F.split("value", "\t")[1].alias("name"))


@query(
    "dataset_check",
    """select 'links' as "table", 'from_orient,from_seg,overlap,to_orient,to_seg' as columns, true as ok
       union all select 'segments', 'LN,SN,SO,SR,id,name,seq', true""",
)
def dataset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two tables of a dataset folder, written from the views, located and checked."""
    folder = _folder(spark)
    raw_segments(spark, sf_dir).write.option("header", True).csv(f"{folder}/{tables.DATASET_SEGMENTS[0]}")
    raw_links(spark, sf_dir).drop("link_id").write.option("header", True).csv(
        f"{folder}/{tables.DATASET_LINKS[0]}"
    )
    return tables.check_dataset(spark, folder).select(
        "table", F.array_join("columns", ",").alias("columns"), "ok"
    )


@query("file_choice", oracle(SEGMENTS_SQL, "select count(*) as n, count(distinct name) as names from g_seg"))
def file_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file whose name only hints at segments, beside one that lacks their columns."""
    folder = _folder(spark)
    raw_segments(spark, sf_dir).write.option("header", True).csv(f"{folder}/my_segs.csv")
    raw_links(spark, sf_dir).limit(9).write.option("header", True).csv(f"{folder}/a_seg.csv")
    chosen = tables.choose_file(spark, folder, "segments")
    return tables.read_segments(spark, chosen).agg(
        F.count("*").alias("n"), F.countDistinct("name").alias("names")
    )


@query(
    "slice_files",
    oracle(
        GRAPH_SQL,
        STRICT_SQL,
        """select slice_id, 'slice_links' as part, count(*) as n from sk group by slice_id
           union all select slice_id, 'slice_segments', count(*) from kept
             where slice_id in (select slice_id from sk) group by slice_id""",
    ),
)
def slice_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slice tables written by closure and contig, read back, complete slices only."""
    made, path = slices(spark, sf_dir, "strict"), _folder(spark)
    layout = made.windows.select("slice_id", "closure", "target_sn")
    edges = made.links.select("slice_id", "u", "v", F.lit(1).alias("label"))
    tables.write_slices(
        {"slice_segments": made.kept, "slice_links": made.links, "slice_edge_pred": edges}, layout, path
    )
    back = tables.read_slices(spark, path)
    whole = tables.complete_slices(back)
    parts = [
        back[name].join(whole, "slice_id", "left_semi").groupBy("slice_id").agg(F.count("*").alias("n"))
        .withColumn("part", F.lit(name))
        for name in ("slice_links", "slice_segments")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "manifest_filter",
    oracle(
        GRAPH_SQL,
        STRICT_SQL,
        "select slice_id, target_sn from win where target_sn in ('GRCh38#0#chr2', 'GRCh38#0#chr3')",
    ),
)
def manifest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = slices(spark, sf_dir, "strict").windows.unionByName(slices(spark, sf_dir, "1hop").windows)
    split = sp.chrom_split(F.col("target_sn"), ["chr5"], ["chr2", "chr3"])
    return sp.filter_manifest(both.withColumn("split", split), "strict", "test").select(
        "slice_id", "target_sn"
    )


@query(
    "shared_contigs",
    oracle(
        GRAPH_SQL,
        ONE_HOP_SQL,
        "select SN from seg_u where SR = 0 intersect select target_sn from win",
    ),
)
def shared_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = graph(spark, sf_dir).segments.filter("SR = 0")
    windows = slices(spark, sf_dir, "1hop").windows.withColumnRenamed("target_sn", "SN")
    return sp.shared_keys(reference, windows, ["SN"])


@query(
    "split_overlaps",
    """select concat('chr', k) as chrom, string_agg(split, ',' order by split) as splits from (
         select distinct c_nationkey % 7 as k,
                case when c_custkey % 3 = 0 then 'train' when c_custkey % 3 = 1 then 'val' else 'test' end as split
         from customer where c_nationkey % 7 < 5 or c_custkey % 3 = 0)
       group by k having count(*) > 1""",
)
def split_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey") % 3
    table = (
        read(spark, sf_dir, "customer")
        .filter((F.col("c_nationkey") % 7 < 5) | (key == 0))
        .select(
            F.concat(F.lit("chr"), (F.col("c_nationkey") % 7).cast("string")).alias("chrom"),
            F.when(key == 0, "train").when(key == 1, "val").otherwise("test").alias("split"),
        )
    )
    return sp.split_overlaps(table).withColumn("splits", F.array_join("splits", ","))


@query(
    "missing_targets",
    oracle(
        SEGMENTS_SQL,
        """select concat('GRCh38#0#chr', n_nationkey) as SN from nation
           except select SN from g_seg""",
    ),
)
def missing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "nation").select(F.concat(F.lit("GRCh38#0#chr"), "n_nationkey").alias("SN"))
    return sp.missing_targets(asked, graph(spark, sf_dir).segments)


@query(
    "contig_intervals",
    oracle(
        SEGMENTS_SQL,
        """select segid, SO, SO + LN as "END" from seg_u where SN = 'GRCh38#0#chr4'""",
    ),
)
def contig_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.contig_intervals(graph(spark, sf_dir).segments, "GRCh38#0#chr4")


def _register_feature_set(feature_set: str) -> None:
    names = ft.FEATURE_SETS[feature_set]
    from seqbraid.plans.q_features import DEGREE_SQL, LABELLED, SEG_DEGREE_SQL, _STRUCT_SQL

    shown = ", ".join(c if c in ("SR", "orient_fwd") else f"round({c}, 6) as {c}" for c in names)
    sql = oracle(
        *LABELLED,
        DEGREE_SQL,
        SEG_DEGREE_SQL,
        _STRUCT_SQL,
        f"select segid, {shown} from sf where segid in (select segid from labels_n)",
    )

    @query(f"feature_set_{feature_set}", sql)
    def features(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = graph(spark, sf_dir)
        rows = labels(spark, sf_dir).select("segid", "chrom", "SO", "LN")
        table, columns = ft.feature_table(rows, g.segments, g.links, feature_set)
        rounded = [c for c in columns if c not in ("SR", "orient_fwd")]
        return table.select(
            "segid", *[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in columns]
        )


for _set in ft.FEATURE_SETS:
    if _set != "linearized_graph":
        _register_feature_set(_set)
