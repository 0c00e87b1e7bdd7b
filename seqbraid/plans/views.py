"""Graph and interval views over the driver's tables, in Spark and as oracle SQL.

The same three views feed every registered query. The Spark side builds them
once per session and input folder and keeps them as Parquet in the shared
folder, the way a pipeline would hand parsed tables to its later stages.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbraid.operators.index import map_links, segment_index
from seqbraid.operators.ordering import with_frames
from seqbraid.session import materialise, plan_by_memory

SEGMENTS_SQL = """
g_seg as (
  select o_orderkey as id, concat('s', o_orderkey) as name, '*' as seq,
         cast(floor(o_totalprice/100) as bigint) as LN,
         case when o_custkey % 4 = 3
              then concat('HG00', o_custkey % 10, '#1#chr', 1 + o_custkey % 6)
              else concat('GRCh38#0#chr', 1 + o_custkey % 6) end as SN,
         cast(date_diff('day', date '1995-01-01', cast(o_orderdate as date)) * 1000
           + (o_orderkey * 7919) % 1000 as bigint) as SO,
         cast(case when o_custkey % 4 = 3 then 1 + o_custkey % 10 else 0 end as integer) as SR
  from orders),
seg_u as (select *, row_number() over (order by id) - 1 as segid from g_seg)"""

LINKS_SQL = """
l_ord as (
  select l_orderkey as a, case when l_returnflag = 'R' then '-' else '+' end as fo, l_partkey,
         row_number() over (order by l_partkey, l_shipdate, l_orderkey, l_linenumber,
                                     l_suppkey, l_extendedprice) - 1 as link_id
  from lineitem),
g_link as (
  select x.link_id, concat('s', x.a) as from_seg, x.fo as from_orient,
         concat('s', y.a) as to_seg, y.fo as to_orient, '0M' as overlap
  from l_ord x join l_ord y on y.link_id = x.link_id + 1 and y.l_partkey = x.l_partkey),
lk as (
  select k.*, s.segid as from_id, t.segid as to_id,
         2 * s.segid + case when from_orient = '-' then 1 else 0 end as u,
         2 * t.segid + case when to_orient = '-' then 1 else 0 end as v
  from g_link k join seg_u s on s.name = k.from_seg join seg_u t on t.name = k.to_seg)"""

INTERVALS_SQL = """
g_bed as (
  select concat('chr', 1 + user_id % 6) as chrom,
         cast(floor(epoch(ts)) as bigint) - 1704067200 as "start",
         cast(floor(epoch(ts)) as bigint) - 1704067200 + 1
           + cast(floor(value * 3) as bigint) as "end",
         concat('E', event_id) as cCRE_acc, concat('R', event_id) as RDHS_id,
         case event_type when 'purchase' then 'PLS' when 'signup' then 'pELS'
              when 'click' then 'dELS' when 'view' then 'CA-CTCF' else 'CA' end as cCRE_class
  from events)"""

GRAPH_SQL = SEGMENTS_SQL + "," + LINKS_SQL


def oracle(*parts: str) -> str:
    """A WITH query: all but the last part are CTE lists, the last is the SELECT."""
    *ctes, select = parts
    return "with " + ",\n".join(c.strip() for c in ctes) + "\n" + select.strip()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    plan_by_memory(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = F.col("o_custkey")
    chrom = (1 + cust % 6).cast("string")
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("s"), F.col("o_orderkey")).alias("name"),
        F.lit("*").alias("seq"),
        F.floor(F.col("o_totalprice") / 100).cast("long").alias("LN"),
        F.when(
            cust % 4 == 3,
            F.concat(F.lit("HG00"), (cust % 10).cast("string"), F.lit("#1#chr"), chrom),
        )
        .otherwise(F.concat(F.lit("GRCh38#0#chr"), chrom))
        .alias("SN"),
        (days.cast("long") * 1000 + (F.col("o_orderkey") * 7919) % 1000).alias("SO"),
        F.when(cust % 4 == 3, 1 + cust % 10).otherwise(0).cast("int").alias("SR"),
    )


def raw_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [
        "l_partkey",
        "l_shipdate",
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "l_extendedprice",
    ]
    ends = (
        read(spark, sf_dir, "lineitem")
        .select(
            *order, F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("from_orient")
        )
    )
    # Consecutive rows meet in blocks of positions, so that no part key is ever gathered
    # into one window partition, and each row is moved once after the sort.
    following = {
        "_part": lambda w: F.lead("l_partkey").over(w),
        "_to": lambda w: F.lead("l_orderkey").over(w),
        "to_orient": lambda w: F.lead("from_orient").over(w),
    }
    kept = ["l_partkey", "l_orderkey", "from_orient"]
    placed = with_frames(ends, order, [], 1, following, keep=kept, name="link_id")
    return placed.filter("_part = l_partkey").select(
        "link_id",
        F.concat(F.lit("s"), "l_orderkey").alias("from_seg"),
        "from_orient",
        F.concat(F.lit("s"), "_to").alias("to_seg"),
        "to_orient",
        F.lit("0M").alias("overlap"),
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01', cast(ts as timestamp_ntz))")
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("chr"), (1 + F.col("user_id") % 6).cast("string")).alias("chrom"),
        start.alias("start"),
        (start + 1 + F.floor(F.col("value") * 3)).alias("end"),
        F.concat(F.lit("E"), F.col("event_id")).alias("cCRE_acc"),
        F.concat(F.lit("R"), F.col("event_id")).alias("RDHS_id"),
        F.when(kind == "purchase", "PLS")
        .when(kind == "signup", "pELS")
        .when(kind == "click", "dELS")
        .when(kind == "view", "CA-CTCF")
        .otherwise("CA")
        .alias("cCRE_class"),
    )


@dataclass(frozen=True)
class Graph:
    """Indexed segments and links with dense ids; the links are built when first asked for."""

    spark: SparkSession
    sf_dir: str
    segments: DataFrame

    @cached_property
    def links(self) -> DataFrame:
        return materialise(map_links(raw_links(self.spark, self.sf_dir), self.segments))

    @property
    def has_links(self) -> bool:
        return "links" in self.__dict__


_graphs: dict[tuple[str, str], Graph] = {}


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The indexed graph of a folder, built on first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _graphs:
        index = materialise(segment_index(raw_segments(spark, sf_dir)))
        _graphs[key] = Graph(spark, sf_dir, index)
    return _graphs[key]
