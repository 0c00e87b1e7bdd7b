"""Registered queries: windows, induced subgraphs, slice checks, negative pairs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbraid.functions.hashing import DRAW_RANGE
from seqbraid.operators import index as ix
from seqbraid.operators import intervals as iv
from seqbraid.operators import sampling as sm
from seqbraid.operators import slices as sl
from seqbraid.plans.registry import query
from seqbraid.plans.q_index import META_SQL
from seqbraid.plans.views import GRAPH_SQL, Graph, graph, oracle
from seqbraid.session import materialise

WINDOW_BP = 500_000


def windows_sql(closure: str) -> str:
    return f"""
win as (
  select distinct SN as target_sn, SO // {WINDOW_BP} * {WINDOW_BP} as w_start,
         SO // {WINDOW_BP} * {WINDOW_BP} + {WINDOW_BP} as w_end,
         concat('slice_', md5(concat(SO // {WINDOW_BP} * {WINDOW_BP}, '|',
                SO // {WINDOW_BP} * {WINDOW_BP} + {WINDOW_BP}, '|{closure}|', SN))) as slice_id
  from seg_u where SN like 'GRCh38%'),
core as (
  select slice_id, segid from win join seg_u on SN = target_sn and SO < w_end and SO + LN > w_start)"""


STRICT_SQL = (
    windows_sql("strict")
    + """,
kept as (select slice_id, segid from core),
sk as (
  select a.slice_id, lk.* from lk join kept a on a.segid = lk.from_id
    join kept b on b.segid = lk.to_id and b.slice_id = a.slice_id)"""
)
ONE_HOP_SQL = (
    windows_sql("1hop")
    + """,
touch as (
  select slice_id, from_id, to_id from lk join core on core.segid = lk.from_id
  union select slice_id, from_id, to_id from lk join core on core.segid = lk.to_id),
kept as (select slice_id, from_id as segid from touch union select slice_id, to_id from touch),
sk as (
  select a.slice_id, lk.* from lk join kept a on a.segid = lk.from_id
    join kept b on b.segid = lk.to_id and b.slice_id = a.slice_id)"""
)


@dataclass(frozen=True)
class Slices:
    """Grid slices; what a query does not ask for is not built."""

    graph: Graph
    closure: str

    @cached_property
    def windows(self) -> DataFrame:
        targets = F.col("SN").startswith("GRCh38")
        return materialise(sl.grid_windows(self.graph.segments, targets, WINDOW_BP, self.closure))

    @cached_property
    def core(self) -> DataFrame:
        return materialise(iv.window_core(self.windows, self.graph.segments))

    @cached_property
    def kept(self) -> DataFrame:
        if self.closure == "strict":
            return self.core.select("slice_id", "segid")
        return materialise(sl.touched_segments(self.graph.links, self.core))

    @cached_property
    def links(self) -> DataFrame:
        return materialise(sl.links_inside(self.graph.links, self.kept))

    def found_edges(self) -> DataFrame:
        """slice_id, link_id, u, v of the links; where they are not built, a plan to be run once."""
        built = self.__dict__.get("edges", self.__dict__.get("links"))
        if built is None and self.closure == "strict":
            built = self.links
        if built is None:
            return sl.touched_edges(self.graph.links, self.core)
        return built.select("slice_id", "link_id", "u", "v")

    @cached_property
    def edges(self) -> DataFrame:
        """`found_edges`, written unless the links are."""
        found = self.found_edges()
        return found if "links" in self.__dict__ else materialise(found)


_slices: dict[tuple[str, str, str], Slices] = {}


def fresh_slices(spark: SparkSession, sf_dir: str, closure: str) -> Slices:
    return Slices(graph(spark, sf_dir), closure)


def slices(spark: SparkSession, sf_dir: str, closure: str) -> Slices:
    """Grid slices, built on first use in a session and kept as tables."""
    key = (spark.sparkContext.applicationId, sf_dir, closure)
    if key not in _slices:
        _slices[key] = fresh_slices(spark, sf_dir, closure)
    return _slices[key]


@query("window_core", oracle(GRAPH_SQL, windows_sql("strict"), "select slice_id, segid from core"))
def window_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = graph(spark, sf_dir).segments
    windows = sl.grid_windows(segments, F.col("SN").startswith("GRCh38"), WINDOW_BP, "strict")
    return iv.window_core(windows, segments)


@query(
    "window_counts",
    oracle(
        GRAPH_SQL,
        windows_sql("strict"),
        "select slice_id as window_id, count(*) as n_core from core group by slice_id",
    ),
)
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = slices(spark, sf_dir, "strict").windows.withColumnRenamed("slice_id", "window_id")
    return iv.overlap_counts(windows, graph(spark, sf_dir).segments)


@query("induced_strict", oracle(GRAPH_SQL, STRICT_SQL, "select slice_id, link_id, u, v from sk"))
def induced_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fresh_slices(spark, sf_dir, "strict").links.select("slice_id", "link_id", "u", "v")


@query("induced_1hop", oracle(GRAPH_SQL, ONE_HOP_SQL, "select slice_id, link_id, u, v from sk"))
def induced_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fresh_slices(spark, sf_dir, "1hop").links.select("slice_id", "link_id", "u", "v")


@query("induced_1hop_nodes", oracle(GRAPH_SQL, ONE_HOP_SQL, "select slice_id, segid from kept"))
def induced_1hop_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fresh_slices(spark, sf_dir, "1hop").kept


def _top_sql(rows: str, value: str, k: int) -> str:
    return f"""select slice_id, string_agg(concat(key, '=', n), ',' order by key) as m from (
        select slice_id, cast({value} as varchar) as key, count(*) as n,
               row_number() over (partition by slice_id order by count(*) desc, cast({value} as varchar)) as r
        from {rows} group by slice_id, {value}) where r <= {k} group by slice_id"""


@query(
    "slice_qc",
    oracle(
        GRAPH_SQL,
        ONE_HOP_SQL,
        f"""ss as (select slice_id, s.* from kept join seg_u s on s.segid = kept.segid),
        nd as (select slice_id, name, count(*) as d from (
               select slice_id, from_seg as name from sk union all select slice_id, to_seg from sk)
               group by slice_id, name),
        prof as (select slice_id, max(d) as max_degree,
                 round(avg(case when d > 2 then 1.0 else 0.0 end), 6) as bf from nd group by slice_id),
        srs as ({_top_sql("ss", "SR", 10)}), sns as ({_top_sql("ss", "SN", 10)}),
        fo as ({_top_sql("sk", "from_orient", 10)}), tos as ({_top_sql("sk", "to_orient", 10)}),
        base as (select slice_id, count(*) as n_segments from ss group by slice_id),
        nl as (select slice_id, count(*) as n_links from sk group by slice_id)""",
        """select b.slice_id, n_segments, coalesce(n_links, 0) as n_links, srs.m as SR_counts_top,
             sns.m as SN_counts_top, coalesce(max_degree, 0) as max_degree,
             coalesce(bf, 0) as branching_frac_deg_gt_2, coalesce(fo.m, '') as from_orient_counts,
             coalesce(tos.m, '') as to_orient_counts
           from base b left join nl using (slice_id) left join prof using (slice_id)
             left join srs using (slice_id) left join sns using (slice_id)
             left join fo using (slice_id) left join tos using (slice_id)""",
    ),
)
def slice_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slices(spark, sf_dir, "1hop")
    segments = s.kept.join(graph(spark, sf_dir).segments, "segid")
    qc = sl.slice_qc(segments, s.links)

    def text(name: str):
        pairs = F.array_sort(F.map_entries(name))
        shown = F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
        return F.array_join(shown, ",").alias(name)

    return qc.select(
        "slice_id",
        "n_segments",
        "n_links",
        text("SR_counts_top"),
        text("SN_counts_top"),
        "max_degree",
        F.round("branching_frac_deg_gt_2", 6).alias("branching_frac_deg_gt_2"),
        text("from_orient_counts"),
        text("to_orient_counts"),
    )


@query(
    "slice_verify",
    oracle(
        GRAPH_SQL,
        ONE_HOP_SQL,
        """ss as (select slice_id, s.* from kept join seg_u s on s.segid = kept.segid where s.id % 97 <> 0),
        lx as (select slice_id, from_seg, to_seg,
                      case when link_id % 101 = 0 then '5M' else '0M' end as overlap from sk),
        dang as (select slice_id, count(*) as n from (
                   select slice_id, from_seg as name from lx union all select slice_id, to_seg from lx) e
                 where not exists (select 1 from ss where ss.slice_id = e.slice_id and ss.name = e.name)
                 group by slice_id),
        sg as (select slice_id, count(*) as n_segments, count(distinct SN) as n_sn from ss group by slice_id),
        lg as (select slice_id, count(*) as n_links, count(*) filter (overlap <> '0M') as n_bad
               from lx group by slice_id),
        nd as (select slice_id, name, count(*) as d from (
               select slice_id, from_seg as name from lx union all select slice_id, to_seg from lx)
               group by slice_id, name),
        mx as (select slice_id, max(d) as max_degree, round(avg(case when d > 2 then 1.0 else 0.0 end), 6) as bf
               from nd group by slice_id),
        chk as (select w.slice_id, w.target_sn, coalesce(dang.n, 0) as dn, coalesce(n_bad, 0) as bad,
                  coalesce(n_sn, 0) as n_sn, coalesce(n_segments, 0) as n_segments,
                  coalesce(n_links, 0) as n_links, coalesce(max_degree, 0) as max_degree,
                  coalesce(bf, 0) as bf
                from win w left join dang using (slice_id) left join sg using (slice_id)
                  left join lg using (slice_id) left join mx using (slice_id))""",
        """select slice_id, target_sn, 'strict' as closure,
             dn = 0 and bad = 0 and n_sn = 1 and false as ok,
             array_to_string(list_filter([
               case when dn > 0 then 'link endpoints are not in the slice''s segments' end,
               case when bad > 0 then 'metadata says overlap_all_0M but links differ' end,
               case when n_sn <> 1 then concat('strict slice with distinct SN: ', n_sn) end,
               'metadata lacks window_bp'], lambda x: x is not null), ' | ') as issues,
             n_segments, n_links, max_degree, bf as branching_frac_deg_gt_2,
             max_degree > 10 as has_cycle_signal_proxy
           from chk""",
    ),
)
def slice_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted faults: missing segments, odd overlaps, a strict flag on one-hop slices, no window_bp."""
    s = slices(spark, sf_dir, "1hop")
    segments = s.kept.join(graph(spark, sf_dir).segments.filter("id % 97 <> 0"), "segid")
    links = s.links.withColumn(
        "overlap", F.when(F.col("link_id") % 101 == 0, "5M").otherwise("0M")
    )
    meta = s.windows.select(
        "slice_id",
        F.lit("window").alias("type"),
        "target_sn",
        "start",
        "end",
        F.lit("strict").alias("closure"),
        F.lit(1).alias("n_segments"),
        F.lit(1).alias("n_links"),
        F.lit(True).alias("overlap_all_0M"),
    )
    checked = sl.verify_slices(segments, links, meta)
    return checked.withColumn("branching_frac_deg_gt_2", F.round("branching_frac_deg_gt_2", 6))


def draw_sql(seed: int, *keys: str) -> str:
    """The portable draw as oracle SQL."""
    return f"cast(concat('0x', substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 15)) as bigint)"


def negatives_sql(rule: sm.NegativeRule, seed: int) -> str:
    pool = "slice_id, SN" if "SN" in rule.pool else "slice_id"
    same = "and a.SN = x.SN" if "SN" in rule.pool else ""
    same_v = same.replace("x.", "y.")
    limit = {"random": 80, "hard_coord_degree": 200, "distance_matched": 400}[rule.sampler]
    accept = "x.oid <> y.oid"
    if rule.anchored:
        tolerance = (
            str(rule.coord_band)
            if rule.sampler == "hard_coord_degree"
            else f"greatest({int(rule.tol_bp)}, cast(floor({rule.tol_frac} * d_pos) as bigint))"
        )
        accept += f" and abs(abs(x.SO - y.SO) - d_pos) <= {tolerance}"
    if rule.degree_matched:
        accept += (
            " and ((x.degree = deg_u and y.degree = deg_v) or (x.degree = deg_v and y.degree = deg_u))"
        )
    own = "slice_id, link_id"
    kinds = "a.degree" if rule.degree_matched else "0"
    sides = "(0), (1)" if rule.degree_matched else "(0)"
    ends = ("deg_u", "deg_v") if rule.degree_matched else ("0", "0")
    group = pool.replace("slice_id", "a.slice_id").replace("SN", "a.SN")
    return f"""
nd as materialized (select slice_id, oid, count(*) as degree from (
         select slice_id, u as oid from sk union all select slice_id, v from sk) group by slice_id, oid),
nodes as materialized (
  select a.slice_id, a.oid, a.degree, a.SN, a.SO,
         row_number() over (partition by {group} order by a.oid) - 1 as rnk,
         count(*) over (partition by {group}) as n, {kinds} as kind,
         row_number() over (partition by {group}, {kinds} order by a.oid) - 1 as first_rank,
         count(*) over (partition by {group}, {kinds}) as n_first
  from (select nd.*, md.SN, md.SO from nd join md on md.oid = nd.oid) a),
anchor as materialized (
  select sk.slice_id, sk.link_id, a.SN, a.n, abs(a.SO - b.SO) as d_pos, a.degree as deg_u, b.degree as deg_v
  from sk join nodes a on a.slice_id = sk.slice_id and a.oid = sk.u
          join nodes b on b.slice_id = sk.slice_id and b.oid = sk.v),
draw as materialized (
  select slice_id, link_id, SN, t, {draw_sql(seed, "slice_id", "link_id", "t * 2")} % n as ru,
         {draw_sql(seed, "slice_id", "link_id", "t * 2 + 1")} % n as rv
  from anchor, range({limit}) r(t)),
pair as materialized (
  select a.slice_id, a.link_id, a.t, x.oid as nu, y.oid as nv
  from draw a join nodes x on x.slice_id = a.slice_id and x.rnk = a.ru {same}
              join nodes y on y.slice_id = a.slice_id and y.rnk = a.rv {same_v}),
tried as materialized (
  select p.slice_id, p.link_id, p.t, nu, nv
  from pair p join anchor a on a.slice_id = p.slice_id and a.link_id = p.link_id
    join nodes x on x.slice_id = p.slice_id and x.oid = nu join nodes y on y.slice_id = p.slice_id and y.oid = nv
  where {accept}),
hit as materialized (
  select {own}, arg_min(nu, t) as u, arg_min(nv, t) as v from tried
  where not exists (select 1 from sk where sk.slice_id = tried.slice_id and sk.u = nu and sk.v = nv)
  group by {own}),
waiting as materialized (
  select a.*, side, case side when 0 then {ends[0]} else {ends[1]} end as kind_u,
         case side when 0 then {ends[1]} else {ends[0]} end as kind_v
  from anchor a, (values {sides}) k(side)
  where not exists (select 1 from hit h where h.slice_id = a.slice_id and h.link_id = a.link_id)),
feasible as materialized (
  select a.slice_id, a.link_id, a.side, x.oid as nu, y.oid as nv,
         (x.first_rank - {draw_sql(seed, "a.slice_id", "a.link_id", "'settle'")} % x.n_first + x.n_first)
           % x.n_first as step,
         row_number() over (partition by a.slice_id, a.link_id, a.side, x.oid order by y.SO, y.oid) - 1 as place,
         count(*) over (partition by a.slice_id, a.link_id, a.side, x.oid) as partners
  from waiting a join nodes x on x.slice_id = a.slice_id and x.kind = a.kind_u {same}
                 join nodes y on y.slice_id = a.slice_id and y.kind = a.kind_v {same_v}
  where {accept} and (a.side = 0 or a.kind_u <> a.kind_v)
    and not exists (select 1 from sk where sk.slice_id = a.slice_id and sk.u = x.oid and sk.v = y.oid)),
neg as materialized (
  select * from hit
  union all
  select {own}, nu, nv from feasible
  where place = {draw_sql(seed, "slice_id", "link_id", "'partner'")} % partners
  qualify row_number() over (partition by {own} order by step, side) = 1)"""


SEED = 42
_RULES = {
    "neg_random": ("strict", sm.NegativeRule("random")),
    "neg_band": ("strict", sm.NegativeRule("hard_coord_degree", True, coord_band=50_000)),
    "neg_distance": ("strict", sm.NegativeRule("distance_matched", True)),
    "neg_distance_degree": (
        "1hop",
        sm.NegativeRule("distance_matched", False, tol_bp=5_000, degree_matched=True),
    ),
}


def _closure_sql(closure: str) -> str:
    return STRICT_SQL if closure == "strict" else ONE_HOP_SQL


def negatives(spark: SparkSession, sf_dir: str, closure: str, rule: sm.NegativeRule) -> DataFrame:
    meta = ix.oriented_metadata(graph(spark, sf_dir).segments)
    return sm.sample_negatives(slices(spark, sf_dir, closure).edges, meta, rule, SEED)


def _register_negatives(key: str, closure: str, rule: sm.NegativeRule) -> None:
    # SQL settles anchors by making their pairs, too many where thousands are left.
    sql = None if rule.degree_matched else oracle(
        GRAPH_SQL,
        META_SQL,
        _closure_sql(closure),
        negatives_sql(rule, SEED),
        "select slice_id, link_id, u, v from neg",
    )

    @query(key, sql)
    def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
        return negatives(spark, sf_dir, closure, rule)


for _key, (_closure, _rule) in _RULES.items():
    _register_negatives(_key, _closure, _rule)

EDGE_PRED_SQL = """
full_slice as (
  select slice_id from (select slice_id, count(*) as p from sk group by slice_id)
    join (select slice_id, count(*) as q from neg group by slice_id) using (slice_id) where q >= p),
ep as (
  select slice_id, u as u_oid, v as v_oid, label, link_id from (
    select slice_id, u, v, 1 as label, link_id from sk
    union all select slice_id, u, v, 0 as label, link_id from neg)
  where slice_id in (select slice_id from full_slice))"""


@query(
    "edge_pred_set",
    oracle(
        GRAPH_SQL,
        META_SQL,
        STRICT_SQL,
        negatives_sql(_RULES["neg_distance"][1], SEED),
        EDGE_PRED_SQL,
        f"select slice_id, u_oid, v_oid, label, {draw_sql(SEED, 'link_id', 'label')} as shuffle_key from ep",
    ),
)
def edge_pred_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = slices(spark, sf_dir, "strict").edges
    drawn = negatives(spark, sf_dir, *_RULES["neg_distance"])
    return sm.balanced_edges(links, drawn, SEED)[0]


@query(
    "drop_edges",
    oracle(
        GRAPH_SQL,
        f"select link_id, u, v from lk where {draw_sql(SEED, 'link_id')} < {int(0.9 * DRAW_RANGE)}",
    ),
)
def drop_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.drop_edges(graph(spark, sf_dir).links, "link_id", 0.1, SEED).select("link_id", "u", "v")


_TRIES = 300


@query(
    "window_best",
    oracle(
        GRAPH_SQL,
        f"""pos as (select *, row_number() over (partition by SN order by SO, segid) - 1 as rnk,
                      count(*) over (partition by SN) as n from seg_u where SN like 'GRCh38%'),
        contig as (select distinct SN, n from pos),
        drawn as (
          select SN, attempt, t, n, {draw_sql(SEED, "SN", "attempt", "t", "'at'")} as hj,
            {draw_sql(SEED, "SN", "attempt", "t", "'shift'")} as hs
          from contig, range(2) a(attempt), range({_TRIES}) b(t)),
        tries as (select d.SN, attempt, t, p.SO - hs % {WINDOW_BP} as w_start
                  from drawn d join pos p on p.SN = d.SN and p.rnk = hj % d.n),
        counted as (select t.SN, attempt, t, w_start, count(*) as n_core
                    from tries t join seg_u s on s.SN = t.SN and s.SO < w_start + {WINDOW_BP}
                      and s.SO + s.LN > w_start group by t.SN, attempt, t, w_start)""",
        f"""select SN as target_sn, attempt, arg_max(w_start, n_core * 1000 - t) as "start",
              arg_max(w_start, n_core * 1000 - t) + {WINDOW_BP} as "end", max(n_core) as n_core
            from counted group by SN, attempt""",
    ),
)
def window_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = graph(spark, sf_dir).segments
    attempts = (
        segments.filter("startswith(SN, 'GRCh38')")
        .select(F.col("SN").alias("target_sn"))
        .distinct()
        .withColumn("attempt", F.explode(F.expr("sequence(0L, 1L)")))
    )
    return sl.choose_windows(segments, attempts, WINDOW_BP, SEED, _TRIES)


@query("slice_builder")
def slice_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of chosen windows; the rounds of attempts have no single-statement form."""
    g = graph(spark, sf_dir)
    targets = g.segments.filter("startswith(SN, 'GRCh38')").select("SN").distinct()
    rule = sm.NegativeRule("random")
    made = sl.build_slices(g.segments, g.links, targets, WINDOW_BP, 5, ("strict", "1hop"), rule, SEED)
    return made["manifest"]
