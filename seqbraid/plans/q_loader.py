"""Registered queries: slices as model input, with the rules by which slices are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbraid.functions.names import sample_id
from seqbraid.operators import index as ix
from seqbraid.operators import sampling as sm
from seqbraid.operators.loader import LoadedSlices, load_slices
from seqbraid.plans.q_features import _NODE_SQL
from seqbraid.plans.q_graph import component_sql, recursive
from seqbraid.plans.q_index import META_SQL
from seqbraid.plans.q_slices import (
    EDGE_PRED_SQL,
    SEED,
    STRICT_SQL,
    draw_sql,
    negatives,
    negatives_sql,
    slices,
    _RULES,
)
from seqbraid.plans.registry import query
from seqbraid.plans.views import GRAPH_SQL, graph
from seqbraid.session import materialise

_loaded: dict[tuple[str, str], LoadedSlices] = {}


def loaded_slices(spark: SparkSession, sf_dir: str) -> LoadedSlices:
    """Strict grid slices with distance-matched pairs, loaded on first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _loaded:
        segments = graph(spark, sf_dir).segments
        s = slices(spark, sf_dir, "strict")
        drawn = negatives(spark, sf_dir, *_RULES["neg_distance"])
        pairs = materialise(sm.balanced_edges(s.links, drawn, SEED)[0])
        samples = segments.select(sample_id(F.col("SN")).alias("sample_id")).distinct()
        listed = samples.filter("sample_id like 'HG00%' and sample_id <> 'HG009'").select(
            "sample_id", (F.substring("sample_id", 5, 1).cast("int") % 5).alias("pop_idx")
        )
        manifest = s.windows.select("slice_id", "target_sn", F.lit("strict").alias("closure"))
        meta = ix.oriented_metadata(segments)
        _loaded[key] = load_slices(manifest, s.links, pairs, meta, listed, seed=SEED)
    return _loaded[key]


_BASE = (GRAPH_SQL, META_SQL, STRICT_SQL, negatives_sql(_RULES["neg_distance"][1], SEED), EDGE_PRED_SQL)
_PAIRS_SQL = f"""
ni as materialized (
  select slice_id, oid, degree, row_number() over (partition by slice_id order by oid) - 1 as idx from nd),
qv as materialized (
  select ep.slice_id, u_oid, v_oid, label, {draw_sql(SEED, 'link_id', 'label')} as shuffle_key,
         a.idx as query_u, b.idx as query_v
  from ep join ni a on a.slice_id = ep.slice_id and a.oid = u_oid
          join ni b on b.slice_id = ep.slice_id and b.oid = v_oid),
qr as materialized (
  select *, count(*) over (partition by slice_id) as n,
         row_number() over (partition by slice_id order by
           {draw_sql(SEED, 'slice_id', 'shuffle_key', 'u_oid', 'v_oid')}, shuffle_key, u_oid, v_oid) - 1 as r
  from qv),
qs as materialized (
  select *, case when r < floor(n * 0.2) then 'test'
                 when r < floor(n * 0.2) + floor(n * 0.1) then 'val' else 'train' end as split
  from qr where n - floor(n * 0.2) - floor(n * 0.1) >= 10),
ok as materialized (select distinct slice_id from qs),
nlinks as (select slice_id, count(*) as n_links from sk group by slice_id),
npairs as (select slice_id, count(*) as n_pairs from ep group by slice_id),
ninside as (select slice_id, count(*) as n_inside from qv group by slice_id),
led as materialized (
  select w.slice_id, w.target_sn, 'strict' as closure, coalesce(n_links, 0) as n_links,
         coalesce(n_pairs, 0) as n_pairs, coalesce(n_inside, 0) as n_inside,
         cast(coalesce(n_inside - floor(n_inside * 0.2) - floor(n_inside * 0.1), 0) as bigint) as n_train
  from win w left join nlinks using (slice_id) left join npairs using (slice_id)
    left join ninside using (slice_id))"""


@query(
    "slice_loader_ledger",
    recursive(
        *_BASE,
        _PAIRS_SQL,
        """select *, case when n_links = 0 then 'no links' when n_pairs = 0 then 'no query pairs'
             when n_inside = 0 then 'no query pair inside' when n_train < 10 then 'too few train pairs'
             end as reason from led""",
    ),
)
def slice_loader_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded_slices(spark, sf_dir).ledger


@query(
    "slice_loader",
    recursive(
        *_BASE,
        _PAIRS_SQL,
        """select l.slice_id, target_sn, closure, n_links, n_train, n_nodes, branching_frac,
             n_pos, n_neg, n_val, n_test
           from led l
             join (select slice_id, count(*) as n_nodes,
                     round(count(*) filter (degree > 2) / cast(count(*) as double), 6) as branching_frac
                   from nd group by slice_id) using (slice_id)
             join (select slice_id, count(*) filter (label = 1) as n_pos, count(*) filter (label = 0) as n_neg,
                     count(*) filter (split = 'val') as n_val, count(*) filter (split = 'test') as n_test
                   from qs group by slice_id) using (slice_id)""",
    ),
)
def slice_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = loaded_slices(spark, sf_dir).slices
    return found.withColumn("branching_frac", F.round("branching_frac", 6))


@query(
    "slice_loader_nodes",
    recursive(
        *_BASE,
        _PAIRS_SQL,
        component_sql("sk"),
        _NODE_SQL,
        """select nf.slice_id, ni.idx, nf.oid, round(case when so_x > 0 then nf.so / so_x else nf.so end, 6) as SO,
             round(case when ln_x > 0 then lnn / ln_x else lnn end, 6) as LN,
             round(case when sr_x > sr_n then (nf.sr - sr_n) / (sr_x - sr_n) else 0.0 end, 6) as SR,
             ref as is_reference, round(case when dg_x > 0 then dg / dg_x else dg end, 6) as degree,
             cast(nf.oid % 2 as double) as orientation,
             round(case when co_x > co_n then (co - co_n) / (co_x - co_n) else 0.0 end, 6) as component,
             md.SO as position,
             cast(case when md.SN like 'GRCh38%' then 6
                  when split_part(md.SN, '#', 1) = 'HG009' then 5
                  else cast(substr(split_part(md.SN, '#', 1), 5) as integer) % 5 end as integer) as pop_idx
           from nf join nx on nx.slice_id = nf.slice_id join ok on ok.slice_id = nf.slice_id
             join ni on ni.slice_id = nf.slice_id and ni.oid = nf.oid join md on md.oid = nf.oid""",
    ),
)
def slice_loader_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("SO", "LN", "SR", "degree", "component")
    nodes = loaded_slices(spark, sf_dir).nodes
    return nodes.withColumns({c: F.round(c, 6) for c in names})


@query(
    "slice_loader_edges",
    recursive(
        *_BASE,
        _PAIRS_SQL,
        """ef as (select sk.slice_id, link_id, p.idx as src, q.idx as dst, abs(a.SO - b.SO) as dso,
             abs(a.SR - b.SR) as dsr, case when sk.u % 2 = sk.v % 2 then 1.0 else 0.0 end as same
           from sk join ok on ok.slice_id = sk.slice_id join md a on a.oid = sk.u join md b on b.oid = sk.v
             join ni p on p.slice_id = sk.slice_id and p.oid = sk.u
             join ni q on q.slice_id = sk.slice_id and q.oid = sk.v),
           mx as (select slice_id, max(dso) as xso, max(dsr) as xsr from ef group by slice_id)""",
        """select ef.slice_id, link_id, src, dst,
             round(case when xso > 0 then dso / cast(xso as double) else 0.0 end, 6) as delta_SO,
             cast(same as double) as same_orient,
             round(case when xsr > 0 then dsr / cast(xsr as double) else 0.0 end, 6) as delta_SR
           from ef join mx on mx.slice_id = ef.slice_id""",
    ),
)
def slice_loader_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = loaded_slices(spark, sf_dir).edges
    return edges.withColumns({c: F.round(c, 6) for c in ("delta_SO", "delta_SR")})


@query(
    "slice_loader_pairs",
    recursive(
        *_BASE,
        _PAIRS_SQL,
        "select slice_id, shuffle_key, u_oid, v_oid, query_u, query_v, label, split from qs",
    ),
)
def slice_loader_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded_slices(spark, sf_dir).pairs
