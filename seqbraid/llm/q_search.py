"""Queries of periodic run detection (11) and ranked lexical search (12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbraid.llm import lexical, periodic
from seqbraid.llm.common import documents, table
from seqbraid.llm.registry import query


def planted(docs: DataFrame) -> DataFrame:
    """Every tenth text, by the hash of its id, with the words from a given one on made periodic."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("words")
    tail = n - F.col("first")
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), g.alias("g"))
    placed = chosen.withColumn("first", F.when(n > 0, F.col("g") % n)).withColumn(
        "step", F.floor(tail / (F.lit(3) + F.col("g") % 8)) + 1
    )
    order = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.when(i < F.col("first"), i)
        .otherwise(F.col("first") + (i - F.col("first")) % F.col("step"))
        .cast("int"),
    )
    changed = F.array_join(F.transform(order, lambda i: F.get("words", i)), " ")
    return placed.select("doc_id", F.when(n > 0, changed).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(planted(documents(spark, sf_dir)))
    top = found.withColumn("top", periodic.strongest(F.col("runs")))
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(periodic.run_table(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_RANKED = r"""
with cut as (
  select doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents),
tf as (select doc_id, term, count(*) as tf from cut group by all),
len as (select doc_id, cast(sum(tf) as bigint) as n from tf group by all),
total as (select count(*) as all_docs, cast(sum(n) as bigint) as all_terms from len),
weight as (
  select term, cast(floor(1000 * ln((2 * any_value(all_docs) + 2)::double
                                    / (2 * count(*) + 1)::double)) as bigint) as w
  from tf, total group by term),
wanted as (
  select distinct item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
scored as (
  select item_id, doc_id,
         cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * all_docs) // all_terms))))
              as bigint) as score
  from wanted join tf using (term) join weight using (term) join len using (doc_id), total
  group by all)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank
      from scored where score > 0)
where rank <= 10
"""


@query("op12_ranked_search", _RANKED)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
