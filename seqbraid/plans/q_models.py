"""Registered queries: fitted models. Fits have no SQL form, so only rows are checked here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbraid.operators import index as ix
from seqbraid.operators import models as md
from seqbraid.operators import sampling as sm
from seqbraid.operators.link_scorer import LinkScores, score_links
from seqbraid.operators.skew import attach
from seqbraid.operators.splits import slice_split
from seqbraid.plans import workflows as wf
from seqbraid.plans.q_index import META_SQL
from seqbraid.plans.q_intervals import LABELS_SQL, labels
from seqbraid.plans.q_slices import (
    ONE_HOP_SQL,
    SEED,
    STRICT_SQL,
    negatives,
    slices,
)
from seqbraid.plans.registry import query
from seqbraid.plans.views import GRAPH_SQL, INTERVALS_SQL, graph, oracle, read
from seqbraid.session import materialise

VAL, TEST = ["chr3"], ["chr2", "chr5"]
LINK_FEATURES = [
    *("delta_so", "deg", "sr_u", "sr_v", "ln_u", "ln_v", "orient_u", "orient_v"),
    *("is_grch38_u", "is_grch38_v", "same_sn"),
]


GRADIENT = 1e-6
_scored: dict[tuple[str, str], LinkScores] = {}


def link_scores(spark: SparkSession, sf_dir: str) -> LinkScores:
    """One scorer for the slices of both closures, fitted on first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _scored:
        g = graph(spark, sf_dir)
        parts = []
        for closure in ("strict", "1hop"):
            s = slices(spark, sf_dir, closure)
            drawn = negatives(spark, sf_dir, closure, sm.NegativeRule("random"))
            edges, _ = sm.balanced_edges(s.edges, drawn, SEED)
            named = s.windows.select("slice_id", "target_sn", F.lit(closure).alias("closure"))
            parts.append(attach(edges, named, ["slice_id"], "inner"))
        edges = parts[0].unionByName(parts[1])
        pairs = slice_split(edges, ["shuffle_key", "u_oid", "v_oid"], SEED).select(
            "slice_id",
            "target_sn",
            "closure",
            F.col("u_oid").alias("u"),
            F.col("v_oid").alias("v"),
            F.col("label").alias("y"),
            "split",
        )
        meta = ix.oriented_metadata(g.segments)
        _scored[key] = score_links(pairs, meta, ix.oriented_degree(g.links), LINK_FEATURES)
    return _scored[key]


@query("lr_link_scorer")
def lr_link_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unweighted logistic link scorer on pair features: test metrics by contig and closure."""
    return link_scores(spark, sf_dir).by_group


def _closure_sizes_sql(closure: str) -> str:
    """Pairs of every slice of a closure whose links all have a feasible negative.

    Random negatives come from the nodes of the slice. Of m nodes, m * (m - 1) ordered
    pairs can be drawn; a slice is lost only if every one of them is a link.
    """
    ctes = (
        STRICT_SQL if closure == "strict" else ONE_HOP_SQL,
        """sn as (select slice_id, count(distinct oid) as m from (select slice_id, u as oid from sk
                   union all select slice_id, v from sk) group by slice_id),
        taken as (select slice_id, count(*) as links from (select distinct slice_id, u, v from sk where u <> v)
                  group by slice_id),
        room as (select slice_id from sn left join taken using (slice_id)
                 where m * (m - 1) > coalesce(links, 0))""",
    )
    last = f"""select sk.slice_id, target_sn, '{closure}' as closure, 2 * count(*) as n
        from sk join win on win.slice_id = sk.slice_id
        where sk.slice_id in (select slice_id from room) group by sk.slice_id, target_sn"""
    return f"({oracle(*ctes, last)})"


LINK_SIZES_SQL = f"""
sizes as (select * from {_closure_sizes_sql("strict")} union all select * from {_closure_sizes_sql("1hop")}),
parted as (
  select *, cast(floor(n * 0.2) as bigint) as n_test,
         cast(n - floor(n * 0.2) - floor(n * 0.1) as bigint) as n_train from sizes)"""


@query(
    "lr_link_support",
    oracle(
        GRAPH_SQL,
        META_SQL,
        LINK_SIZES_SQL,
        """select target_sn, closure, cast(sum(n_test) as bigint) as n_edges from parted where n_train >= 10
           group by target_sn, closure having sum(n_test) > 0""",
    ),
)
def lr_link_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of test pairs behind every line of the scorer's report."""
    return link_scores(spark, sf_dir).by_group.select("target_sn", "closure", "n_edges")


@query(
    "lr_link_certificate",
    oracle(
        GRAPH_SQL,
        META_SQL,
        LINK_SIZES_SQL,
        "select cast(sum(n_train) as bigint) as n_train, true as optimal from parted where n_train >= 10",
    ),
)
def lr_link_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorer's fit is the optimum of its loss over all train pairs."""
    return _proved(link_scores(spark, sf_dir).certificate).drop("n_pos")


def _proved(certificate: DataFrame) -> DataFrame:
    return certificate.select("n_train", "n_pos", (F.col("max_gradient") < GRADIENT).alias("optimal"))


def _node_study(spark: SparkSession, sf_dir: str, method: str, **options: int) -> dict[str, DataFrame]:
    g = graph(spark, sf_dir)
    return wf.aligned_baseline(
        labels(spark, sf_dir),
        g.segments,
        g.links,
        VAL,
        TEST,
        method,
        "linearized_graph",
        "binary",
        one_label=True,
        **options,
    )


@query("lr_node")
def lr_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node_study(spark, sf_dir, "logistic")["binary"]


_UNIVERSE_SQL = f"""
inside as (select segid from ({oracle(STRICT_SQL, "select segid from kept")})
           union select segid from ({oracle(ONE_HOP_SQL, "select segid from kept")})),
study as (
  select segid, case when ccre_class = 'background' then 0 else 1 end as y,
         case when chrom in ('chr2', 'chr5') then 'test' when chrom = 'chr3' then 'val' else 'train' end as split
  from labels_n where segid in (select segid from inside))"""
_universes: dict[tuple[str, str], dict[str, DataFrame]] = {}


def _universe_study(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Node classification over the segments of the grid slices only, both closures."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _universes:
        g = graph(spark, sf_dir)
        both = [(c, slices(spark, sf_dir, c)) for c in ("strict", "1hop")]
        kept = both[0][1].kept.select("slice_id", "segid").unionByName(
            both[1][1].kept.select("slice_id", "segid")
        )
        windows = [
            s.windows.select("slice_id", "target_sn", F.lit(c).alias("closure")) for c, s in both
        ]
        _universes[key] = wf.aligned_baseline(
            labels(spark, sf_dir),
            g.segments,
            g.links,
            VAL,
            TEST,
            "logistic",
            "linearized_graph",
            "binary",
            universe=(kept, windows[0].unionByName(windows[1])),
            one_label=True,
        )
    return _universes[key]


@query(
    "aligned_universe",
    oracle(
        GRAPH_SQL,
        INTERVALS_SQL,
        LABELS_SQL,
        _UNIVERSE_SQL,
        """select c.y, class_name, t.split, (select count(*) from study s where s.y = c.y and s.split = t.split) as n
           from (values (0, 'background'), (1, 'ccre')) c(y, class_name), (values ('train'), ('test')) t(split)""",
    ),
)
def aligned_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every class in the train and test split of the study on slice segments."""
    return _universe_study(spark, sf_dir)["label_counts"]


@query(
    "aligned_universe_certificate",
    oracle(
        GRAPH_SQL,
        INTERVALS_SQL,
        LABELS_SQL,
        _UNIVERSE_SQL,
        """select count(*) as n_train, count(*) filter (y = 1) as n_pos, true as optimal
           from study where split = 'train'""",
    ),
)
def aligned_universe_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study's logistic fit is the optimum of its weighted loss over exactly these rows."""
    return _proved(_universe_study(spark, sf_dir)["certificate"])


@query("mlp_node")
def mlp_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node_study(spark, sf_dir, "mlp", max_iter=200)["binary"]


@query("rf_node")
def rf_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node_study(spark, sf_dir, "random_forest", trees=400)["per_chrom"]


@query("structural_baseline")
def structural_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    study = wf.structural_baseline(
        labels(spark, sf_dir), g.segments, g.links, VAL, TEST, negative_fraction=0.5, one_label=True
    )
    return study["binary"]


@query("multiclass_baseline")
def multiclass_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    study = wf.structural_baseline(labels(spark, sf_dir), g.segments, g.links, VAL, TEST, binary=False)
    return study["per_class"]


@query("embedding_baseline")
def embedding_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean embeddings per segment against the nine-class label of the embedding table."""
    rows = read(spark, sf_dir, "embeddings")
    vectors = rows.select(
        F.col("vec_id").alias("oid"), F.col("embedding").cast("array<double>").alias("x")
    )
    segment = F.shiftright("vec_id", 1)
    known = rows.groupBy(segment.alias("segid")).agg((F.min("label") % 9).alias("ccre_label"))
    known = known.withColumn("chrom", F.concat(F.lit("chr"), (1 + F.col("segid") % 6).cast("string")))
    study = wf.embedding_baseline(known, vectors, 64, VAL, TEST, scheme="group3")
    return study["per_class"]


@query(
    "standardized_features",
    oracle(
        """x as (select l_orderkey, l_linenumber, l_quantity as a, l_extendedprice as b, l_shipdate < timestamp '1996-01-01' as train
                from lineitem),
           m as (select avg(a) as ma, stddev_pop(a) as sa, avg(b) as mb, stddev_pop(b) as sb from x where train)""",
        """select l_orderkey, l_linenumber, round((a - ma) / sa, 5) + 0.0 as a, round((b - mb) / sb, 5) + 0.0 as b
           from x, m""",
    ),
)
def standardized_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("a"),
        F.col("l_extendedprice").alias("b"),
        (F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")).alias("train"),
    )
    scaler = md.Standardizer(rows.filter("train"), ["a", "b"])
    scaled = rows.select("l_orderkey", "l_linenumber", *scaler.expressions())
    return scaled.withColumns({c: F.round(c, 5) + F.lit(0.0) for c in ("a", "b")})


@query("pca2")
def pca2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.project_two(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
