"""Registered queries: features, splits, encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbraid.functions.names import segid_from_label
from seqbraid.functions.vectors import adaptive_window, pair_interaction, sinusoidal_encoding
from seqbraid.operators import features as ft
from seqbraid.operators import graph as gr
from seqbraid.operators import index as ix
from seqbraid.operators import sampling as sm
from seqbraid.operators import splits as sp
from seqbraid.plans.q_graph import component_sql, recursive
from seqbraid.plans.q_index import DEGREE_SQL, META_SQL, SEG_DEGREE_SQL
from seqbraid.plans.q_intervals import LABELS_SQL, labels
from seqbraid.plans.q_slices import ONE_HOP_SQL, STRICT_SQL, draw_sql, slices
from seqbraid.plans.registry import query
from seqbraid.plans.views import GRAPH_SQL, INTERVALS_SQL, graph, oracle, read

SEED = 42
LABELLED = (GRAPH_SQL, INTERVALS_SQL, LABELS_SQL)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.oriented_metadata(graph(spark, sf_dir).segments)


@query(
    "pair_features",
    oracle(
        GRAPH_SQL,
        META_SQL,
        DEGREE_SQL,
        """select lk.link_id, lk.u, lk.v, abs(a.SO - b.SO) as delta_so, x.degree + y.degree as deg,
             a.SR as sr_u, b.SR as sr_v, a.LN as ln_u, b.LN as ln_v,
             cast(lk.u % 2 as integer) as orient_u, cast(lk.v % 2 as integer) as orient_v,
             a.is_reference as is_grch38_u, b.is_reference as is_grch38_v,
             case when a.SN = b.SN then 1 else 0 end as same_sn
           from lk join md a on a.oid = lk.u join md b on b.oid = lk.v
             join deg x on x.oid = lk.u join deg y on y.oid = lk.v""",
    ),
)
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = graph(spark, sf_dir).links.select("link_id", "u", "v")
    return ft.pair_features(links, _meta(spark, sf_dir), ix.oriented_degree(links))


_NODE_SQL = """
nf as (
  select comp.slice_id, comp.oid, ln(1 + abs(SO)) as so, ln(1 + LN) as lnn, cast(SR as double) as sr,
         cast(is_reference as double) as ref, ln(1 + degree) as dg, cast(component as double) as co
  from comp join md on md.oid = comp.oid
    join (select slice_id, oid, count(*) as degree from (select slice_id, u as oid from sk
          union all select slice_id, v from sk) group by slice_id, oid) d
      on d.slice_id = comp.slice_id and d.oid = comp.oid),
nx as (select slice_id, max(so) as so_x, max(lnn) as ln_x, max(sr) as sr_x, min(sr) as sr_n, max(dg) as dg_x,
         max(co) as co_x, min(co) as co_n from nf group by slice_id)"""


@query(
    "node_features",
    recursive(
        GRAPH_SQL,
        META_SQL,
        STRICT_SQL,
        component_sql("sk"),
        _NODE_SQL,
        """select nf.slice_id, oid, round(case when so_x > 0 then so / so_x else so end, 6) as SO,
             round(case when ln_x > 0 then lnn / ln_x else lnn end, 6) as LN,
             round(case when sr_x > sr_n then (sr - sr_n) / (sr_x - sr_n) else 0.0 end, 6) as SR,
             ref as is_reference, round(case when dg_x > 0 then dg / dg_x else dg end, 6) as degree,
             cast(oid % 2 as double) as orientation,
             round(case when co_x > co_n then (co - co_n) / (co_x - co_n) else 0.0 end, 6) as component,
             row_number() over (partition by nf.slice_id order by oid) - 1 as idx
           from nf join nx on nx.slice_id = nf.slice_id""",
    ),
)
def node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = slices(spark, sf_dir, "strict").links
    parts = gr.components(links, ["slice_id"])
    table = ft.slice_node_table(links, _meta(spark, sf_dir), parts)
    return _rounded(table, "SO", "LN", "SR", "degree", "component")


@query(
    "edge_features_slice",
    oracle(
        GRAPH_SQL,
        META_SQL,
        ONE_HOP_SQL,
        """ef as (select sk.slice_id, link_id, abs(a.SO - b.SO) as dso, abs(a.SR - b.SR) as dsr,
             case when sk.u % 2 = sk.v % 2 then 1.0 else 0.0 end as so
           from sk join md a on a.oid = sk.u join md b on b.oid = sk.v),
           mx as (select slice_id, max(dso) as xso, max(dsr) as xsr from ef group by slice_id)""",
        """select ef.slice_id, link_id,
             round(case when xso > 0 then dso / cast(xso as double) else 0.0 end, 6) as delta_SO,
             cast(so as double) as same_orient,
             round(case when xsr > 0 then dsr / cast(xsr as double) else 0.0 end, 6) as delta_SR
           from ef join mx on mx.slice_id = ef.slice_id""",
    ),
)
def edge_features_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = slices(spark, sf_dir, "1hop").edges
    table = ft.edge_features(links, _meta(spark, sf_dir), ["slice_id"]).drop("u", "v")
    return _rounded(table, "delta_SO", "delta_SR")


@query(
    "dense_edges",
    oracle(
        GRAPH_SQL,
        STRICT_SQL,
        """nn as (select distinct slice_id, u as oid from sk union select slice_id, v from sk),
           ni as (select *, row_number() over (partition by slice_id order by oid) - 1 as idx from nn)""",
        """select sk.slice_id, link_id, a.idx as src, b.idx as dst from sk
             join ni a on a.slice_id = sk.slice_id and a.oid = sk.u
             join ni b on b.slice_id = sk.slice_id and b.oid = sk.v""",
    ),
)
def dense_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = slices(spark, sf_dir, "strict").links
    return ft.dense_edge_index(links, ["slice_id"]).select("slice_id", "link_id", "src", "dst")


_STRUCT_SQL = """
sf as (select s.segid, ln(1 + abs(SO)) as log1p_SO, ln(1 + LN) as log1p_LN, cast(SR as double) as SR,
         ln(1 + degree) as log1p_degree, cast(0 as double) as orient_fwd
       from seg_u s join sdeg d on d.segid = s.segid)"""


@query(
    "structural_features",
    oracle(
        GRAPH_SQL,
        DEGREE_SQL,
        SEG_DEGREE_SQL,
        _STRUCT_SQL,
        """select segid, round(log1p_SO, 6) as log1p_SO, round(log1p_LN, 6) as log1p_LN, SR,
             round(log1p_degree, 6) as log1p_degree, orient_fwd from sf""",
    ),
)
def structural_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    table = ft.structural_features(g.segments.select("segid"), g.segments, g.links)
    return _rounded(table, "log1p_SO", "log1p_LN", "log1p_degree")


_CONTEXT_SQL = """
base as (select l.segid, chrom, SO, LN, degree from labels_n l join sdeg d on d.segid = l.segid),
ctx as (
  select segid, chrom, lag(LN) over w as prev_ln, lead(LN) over w as next_ln,
         SO - (lag(SO) over w + lag(LN) over w) as prev_gap, lead(SO) over w - (SO + LN) as next_gap,
         avg(LN) over (w rows between 2 preceding and 2 following) as rolling_ln_mean,
         avg(degree) over (w rows between 2 preceding and 2 following) as rolling_degree_mean
  from base window w as (partition by chrom order by SO, segid))"""
_CONTEXT_COLUMNS = ", ".join(
    f"round(ln(1 + greatest(coalesce({c}, 0), 0)), 6) as {c}" for c in ft.CONTEXT_FEATURES
)


@query(
    "linear_context",
    oracle(
        *LABELLED,
        DEGREE_SQL,
        SEG_DEGREE_SQL,
        _CONTEXT_SQL,
        f"select segid, chrom, {_CONTEXT_COLUMNS} from ctx",
    ),
)
def linear_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    rows = labels(spark, sf_dir).select("segid", "chrom", "SO", "LN")
    rows = rows.join(ix.segment_degree(g.links, g.segments), "segid")
    table = ft.context_features(rows).select("segid", "chrom", *ft.CONTEXT_FEATURES)
    return _rounded(table, *ft.CONTEXT_FEATURES)


@query(
    "feature_set_linearized",
    oracle(
        *LABELLED,
        DEGREE_SQL,
        SEG_DEGREE_SQL,
        _STRUCT_SQL,
        _CONTEXT_SQL,
        f"""select sf.segid, round(log1p_SO, 6) as log1p_SO, round(log1p_LN, 6) as log1p_LN, SR,
              round(log1p_degree, 6) as log1p_degree, {_CONTEXT_COLUMNS}
            from sf join ctx on ctx.segid = sf.segid""",
    ),
)
def feature_set_linearized(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    rows = labels(spark, sf_dir).select("segid", "chrom", "SO", "LN")
    table, names = ft.feature_table(rows, g.segments, g.links, "linearized_graph")
    return _rounded(table.select("segid", *names), *[n for n in names if n != "SR"])


@query(
    "sinusoidal_pe",
    oracle(
        GRAPH_SQL,
        "fr as (select i, pow(10000.0, -2.0 * i / 64) as f from range(32) r(i))",
        """select segid, cast(i as integer) as i,
             round(cast(cast(sin(SO / 3.2e9 * f) as float) as double), 5) as s,
             round(cast(cast(cos(SO / 3.2e9 * f) as float) as double), 5) as c
           from seg_u, fr""",
    ),
)
def sinusoidal_pe(spark: SparkSession, sf_dir: str) -> DataFrame:
    waves = graph(spark, sf_dir).segments.select("segid", sinusoidal_encoding(F.col("SO")).alias("pe"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda i: F.struct(F.get("pe", 2 * i).alias("s"), F.get("pe", 2 * i + 1).alias("c")),
    )
    return waves.select("segid", F.posexplode(pairs).alias("i", "w")).select(
        "segid",
        "i",
        F.round(F.col("w.s").cast("double"), 5).alias("s"),
        F.round(F.col("w.c").cast("double"), 5).alias("c"),
    )


@query(
    "pair_interaction",
    """with e as (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as p
                  from embeddings),
        two as (select a.vec_id, a.p, cast(a.x as double) as x, cast(b.x as double) as y
                from e a join e b on b.vec_id = a.vec_id + 1 and b.p = a.p)
       select vec_id, cast(p as integer) as pos, round(x, 4) as value from two
       union all select vec_id, cast(p + 64 as integer), round(y, 4) from two
       union all select vec_id, cast(p + 128 as integer), round(x * y, 4) from two
       union all select vec_id, cast(p + 192 as integer), round(abs(x - y), 4) from two""",
)
def pair_interaction_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x")
    )
    other = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    features = pair_interaction(F.col("x"), F.col("y"))
    return (
        vectors.join(other, "vec_id")
        .select("vec_id", F.posexplode(features).alias("pos", "value"))
        .withColumn("value", F.round("value", 4))
    )


@query(
    "adaptive_window",
    oracle(
        GRAPH_SQL,
        STRICT_SQL,
        """sd as (select slice_id, oid, count(*) as degree from (select slice_id, u as oid from sk
             union all select slice_id, v from sk) group by slice_id, oid),
           bf as (select slice_id, count(*) filter (degree > 2) / cast(count(*) as double) as b
                  from sd group by slice_id)""",
        """select slice_id, cast(greatest(32, least(256, floor(32 * (1.0 + 4.0 * b)))) as integer) as window_k
           from bf""",
    ),
)
def adaptive_window_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    degrees = ix.oriented_degree(slices(spark, sf_dir, "strict").links, ("slice_id",))
    share = degrees.groupBy("slice_id").agg((F.count_if(F.col("degree") > 2) / F.count("*")).alias("b"))
    return share.select("slice_id", adaptive_window(F.col("b")).alias("window_k"))


@query(
    "segid_labels",
    """select o_orderkey, case when o_orderkey % 3 = 2 then null else o_orderkey end as segid
       from orders""",
)
def segid_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    raw = F.when(key % 3 == 0, F.concat(F.lit("s"), key)).when(key % 3 == 1, key.cast("string"))
    raw = raw.otherwise(F.concat(F.lit("x"), key))
    return read(spark, sf_dir, "orders").select("o_orderkey", segid_from_label(raw).alias("segid"))


@query(
    "chrom_split",
    oracle(
        *LABELLED,
        """select segid, case when chrom in ('chr2', 'chr5') then 'test' when chrom = 'chr3' then 'val'
                              else 'train' end as split from labels_n""",
    ),
)
def chrom_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = sp.chrom_split(F.col("SN"), ["chr3"], ["GRCh38#0#chr2", "chr5"])
    return labels(spark, sf_dir).select("segid", split.alias("split"))


@query(
    "slice_split",
    oracle(
        GRAPH_SQL,
        ONE_HOP_SQL,
        f"""rk as (select slice_id, link_id, count(*) over (partition by slice_id) as n,
               row_number() over (partition by slice_id order by {draw_sql(SEED, 'slice_id', 'link_id')}, link_id) - 1
                 as r from sk)""",
        """select slice_id, link_id, case when r < floor(n * 0.2) then 'test'
             when r < floor(n * 0.2) + floor(n * 0.1) then 'val' else 'train' end as split
           from rk where n - floor(n * 0.2) - floor(n * 0.1) >= 10""",
    ),
)
def slice_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = slices(spark, sf_dir, "1hop").edges.select("slice_id", "link_id")
    return sp.slice_split(edges, ["link_id"], SEED)


@query(
    "downsample",
    oracle(
        *LABELLED,
        f"""bg as (select segid, row_number() over (order by {draw_sql(SEED, 'segid')}, segid) as r,
                     count(*) over () as n from labels_n where ccre_class = 'background')""",
        """select segid from labels_n where ccre_class <> 'background'
           union all select segid from bg where r <= floor(n * 0.3)""",
    ),
)
def downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels(spark, sf_dir).select("segid", "ccre_class")
    return sm.downsample(rows, F.col("ccre_class") == "background", 0.3, "segid", SEED).select("segid")


@query(
    "covered_segments",
    oracle(
        *LABELLED,
        STRICT_SQL,
        """select distinct kept.segid from kept join win on win.slice_id = kept.slice_id
             join labels_n l on l.segid = kept.segid
           where target_sn in ('GRCh38#0#chr2', 'GRCh38#0#chr5')""",
    ),
)
def covered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slices(spark, sf_dir, "strict")
    return sp.covered_segments(
        s.kept, s.windows, labels(spark, sf_dir), ["strict"], "test", ["chr3"], ["chr2", "chr5"]
    )


@query(
    "node_label_lookup",
    oracle(
        *LABELLED,
        ONE_HOP_SQL,
        """nn as (select distinct slice_id, u as oid from sk union select slice_id, v from sk),
           nl as (select nn.slice_id, oid, oid // 2 as segid, ccre_label from nn
                  left join labels_n l on l.segid = nn.oid // 2)""",
        """select * from nl where slice_id in (
             select slice_id from nl group by slice_id having count(ccre_label) >= 4)""",
    ),
)
def node_label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = ix.oriented_nodes(slices(spark, sf_dir, "1hop").edges, ("slice_id",))
    return ft.labels_on_nodes(nodes, labels(spark, sf_dir))


@query(
    "query_edges",
    oracle(
        GRAPH_SQL,
        STRICT_SQL,
        """nn as (select distinct slice_id, u as oid from sk union select slice_id, v from sk),
           cand as (select w.slice_id, lk.link_id, u as u_oid, v as v_oid from win w join seg_u s on s.SN = target_sn
                    join lk on lk.from_id = s.segid)""",
        """select c.slice_id, link_id, u_oid, v_oid from cand c
             join nn a on a.slice_id = c.slice_id and a.oid = u_oid
             join nn b on b.slice_id = c.slice_id and b.oid = v_oid""",
    ),
)
def query_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, s = graph(spark, sf_dir), slices(spark, sf_dir, "strict")
    contig = g.segments.select(F.col("segid").alias("from_id"), F.col("SN").alias("target_sn"))
    candidates = (
        g.links.join(contig, "from_id")
        .join(s.windows.select("slice_id", "target_sn"), "target_sn")
        .select("slice_id", "link_id", F.col("u").alias("u_oid"), F.col("v").alias("v_oid"))
    )
    return ft.query_edges_in_slice(candidates, s.links)
