"""Registered queries: interval overlap, dominant classes and label spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbraid.operators import intervals as iv
from seqbraid.operators import labels as lb
from seqbraid.plans.registry import query
from seqbraid.plans.views import INTERVALS_SQL, SEGMENTS_SQL, graph, intervals, oracle
from seqbraid.schemas import ELEMENT_CLASSES, ELEMENT_PRIORITY
from seqbraid.session import materialise

_PRIORITY_VALUES = ", ".join(
    f"({i}, '{c}', {ELEMENT_PRIORITY[c]})" for i, c in enumerate(ELEMENT_CLASSES)
)
LABELS_SQL = f"""
cls as (select * from (values {_PRIORITY_VALUES}) t(ccre_label, ccre_class, priority)),
ref as (
  select segid, SN, split_part(SN, '#', 3) as chrom, SO, LN from seg_u
  where SN like 'GRCh38%' and split_part(SN, '#', 3) in (select chrom from g_bed)),
bp as (
  select segid, cCRE_class as ccre_class,
         cast(sum(least("end", SO + LN) - greatest("start", SO)) as bigint) as overlap_bp
  from ref join g_bed b on b.chrom = ref.chrom and b."start" < SO + LN and b."end" > SO and LN > 0
  group by segid, cCRE_class),
node_lab as (
  select r.segid, 2 * r.segid as oid_fwd, 2 * r.segid + 1 as oid_rev, SN, chrom, SO, LN,
         coalesce(arg_max(bp.ccre_class, overlap_bp * 1000 + priority), 'background') as ccre_class,
         cast(coalesce(sum(overlap_bp), 0) as bigint) as overlap_bp,
         coalesce(max(overlap_bp), 0) as dominant_class_overlap_bp,
         cast(count(bp.segid) as integer) as n_ccres_touching
  from ref r left join bp on bp.segid = r.segid left join cls on cls.ccre_class = bp.ccre_class
  group by r.segid, SN, chrom, SO, LN),
labels_n as (select n.*, c.ccre_label from node_lab n join cls c on c.ccre_class = n.ccre_class)"""

BASE = (SEGMENTS_SQL, INTERVALS_SQL, LABELS_SQL)
_labels: dict[tuple[str, str], DataFrame] = {}


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node labels, built on first use in a session and kept as a table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _labels:
        _labels[key] = materialise(_fresh_labels(spark, sf_dir))
    return _labels[key]


def _fresh_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.node_labels(intervals(spark, sf_dir), graph(spark, sf_dir).segments)


@query("interval_overlap_bp", oracle(*BASE, "select segid, ccre_class, overlap_bp from bp"))
def interval_overlap_bp(spark: SparkSession, sf_dir: str) -> DataFrame:
    bed = intervals(spark, sf_dir)
    return iv.class_overlaps(bed, iv.reference_segments(graph(spark, sf_dir).segments, bed))


@query(
    "dominant_class",
    oracle(*BASE, "select segid, ccre_class, overlap_bp, dominant_class_overlap_bp from node_lab"),
)
def dominant_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fresh_labels(spark, sf_dir).select(
        "segid", "ccre_class", "overlap_bp", "dominant_class_overlap_bp"
    )


@query("node_labels", oracle(*BASE, "select * from labels_n"))
def node_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fresh_labels(spark, sf_dir)


_COUNTS = ", ".join(
    f"count(*) filter (ccre_class = '{c}') as \"{c}\"" for c in ELEMENT_CLASSES
)


@query(
    "class_crosstab",
    oracle(*BASE, f'select chrom, {_COUNTS}, count(*) as "TOTAL" from node_lab group by chrom'),
)
def class_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.class_crosstab(labels(spark, sf_dir))


@query(
    "label_summary",
    oracle(
        *BASE,
        """select c.ccre_label, c.ccre_class,
                  (select count(*) from node_lab n where n.ccre_class = c.ccre_class) as n,
                  (select round(avg(case when ccre_class <> 'background' then 1.0 else 0.0 end), 6)
                     from node_lab) as frac_labeled_nonbg,
                  (select string_agg(distinct chrom, ',' order by chrom) from node_lab) as chroms_covered
           from cls c""",
    ),
)
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        iv.label_summary(labels(spark, sf_dir))
        .withColumn("frac_labeled_nonbg", F.round("frac_labeled_nonbg", 6))
        .withColumn("chroms_covered", F.array_join("chroms_covered", ","))
    )


def _remap_sql(scheme: str) -> str:
    # The expected labels of the nine classes, in class order, stated here once more.
    expected = {
        "binary": "011111111",
        "group3": "021122222",
        "group4": "021132333",
        "group5": "021132334",
        "full9": "012345678",
    }[scheme]
    cases = " ".join(f"when {i} then {v}" for i, v in enumerate(expected))
    return oracle(*BASE, f"select segid, cast(case ccre_label {cases} end as integer) as y from labels_n")


def _register_scheme(key: str, scheme: str) -> None:
    @query(key, _remap_sql(key.removeprefix("label_")))
    def remapped(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lb.label_set(labels(spark, sf_dir), scheme)[0].select("segid", "y")


for _key, _scheme in (
    ("label_binary", "binary_ccre"),
    ("label_group3", "three"),
    ("label_group4", "4class"),
    ("label_group5", "five"),
    ("label_full9", "multiclass"),
):
    _register_scheme(_key, _scheme)


@query(
    "label_category",
    oracle(
        *BASE,
        """select segid, case when ccre_class in ('pELS', 'dELS') then 1 else 0 end as y from labels_n
           where ccre_class in ('pELS', 'dELS', 'background')""",
    ),
)
def label_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = lb.label_set(labels(spark, sf_dir), "category-binary", "enhancer-like")
    return rows.select("segid", "y")


@query(
    "label_category_all_negative",
    oracle(
        *BASE,
        """select segid, case when ccre_class in ('TF', 'CA-CTCF', 'CA-TF') then 1 else 0 end as y
           from labels_n""",
    ),
)
def label_category_all_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = lb.label_set(labels(spark, sf_dir), "category_binary", "ctcf_tf", False)
    return rows.select("segid", "y")


_GROUP4 = " ".join(f"when {i} then {v}" for i, v in enumerate("021132333"))
_GROUP4_NAMES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(lb.SCHEME_CLASSES["group4"]))
GROUP4_SQL = f"""
g4 as (select segid, chrom, case ccre_label {_GROUP4} end as y from labels_n),
g4n as (select * from (values {_GROUP4_NAMES}) t(y, class_name)),
g4c as (select n.y, n.class_name, (select count(*) from g4 where g4.y = n.y) as n from g4n n)"""


@query("label_counts", oracle(*BASE, GROUP4_SQL, "select y, class_name, n from g4c"))
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = lb.label_set(labels(spark, sf_dir), "group4")
    return lb.label_counts(rows, names)


def _weights_sql(expr: str) -> str:
    return oracle(
        *BASE,
        f"""cw as (select c.ccre_label as y, c.ccre_class as class_name,
              (select count(*) from labels_n l where l.ccre_label = c.ccre_label) as n from cls c),
            fr as (select *, greatest(n / (select cast(sum(greatest(n, 1)) as double) from cw), 1e-6) as f
                   from cw),
            wt as (select *, {expr} as w from fr)""",
        "select y, class_name, n, round(w / (select avg(w) from wt), 6) as weight from wt",
    )


def _register_weights(mode: str, expr: str) -> None:
    @query(f"class_weights_{mode}", _weights_sql(expr))
    def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, names = lb.label_set(labels(spark, sf_dir), "full9")
        return lb.class_weights(rows, names, mode).withColumn("weight", F.round("weight", 6))


_register_weights("inverse", "1.0 / f")
_register_weights("inverse_sqrt", "1.0 / sqrt(f)")


@query(
    "overlap_pairs",
    oracle(
        *BASE,
        """select segid, b.cCRE_acc from ref join g_bed b on b.chrom = ref.chrom
             and b."start" < SO + LN and b."end" > SO""",
    ),
)
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bed = intervals(spark, sf_dir).select("chrom", "start", "end", "cCRE_acc")
    segs = iv.reference_segments(graph(spark, sf_dir).segments, bed).select(
        "segid", "chrom", F.col("SO").alias("start"), (F.col("SO") + F.col("LN")).alias("end")
    )
    return iv.overlap_pairs(segs, bed, ["chrom"]).select("segid", "cCRE_acc")
