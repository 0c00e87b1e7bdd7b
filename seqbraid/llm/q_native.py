"""Queries of sharding (8), line de-duplication (9) and URL filters (10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbraid.llm import line_dedup, sharding, url_filter
from seqbraid.llm.common import documents, table
from seqbraid.llm.registry import query

# The rules of the URL contract, (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
# Host labels that put a host on the block list of the query.
SPAM_HOST = r"(^|[.-])(casino|bets|pills|adult|ads)([.-]|$)"


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id")
    return sharding.place(docs, F.col("doc_id"), sharding.shard_names())


_LINE_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as pos
  from d),
keyed as (
  select doc_id, pos, line,
         translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
dup as (
  select key, min(doc_id) as first_doc from keyed
  where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
marked as (
  select k.*, coalesce(k.doc_id > dup.first_doc, false) as gone
  from keyed k left join dup on dup.key = k.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), ''))
         as kept_sha256
from marked group by doc_id
"""


@query("op9_line_dedup", _LINE_SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_URL_SQL = r"""
with p as (
  select page_id, coalesce(url, '') as url from pages),
parts as (
  select page_id,
         translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path
  from p),
rules(verdict, rule_host, rule_path) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
         ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'),
         ('block', 'net', '/fr/')),
fit as (
  select page_id, verdict, concat(rule_host, rule_path) as rule,
         row_number() over (partition by page_id
                            order by length(rule_host) + length(rule_path) desc) as k
  from parts join rules
    on (host = rule_host or ends_with(host, concat('.', rule_host)))
   and starts_with(path, rule_path))
select page_id, host, path, rule,
       coalesce(verdict,
                case when regexp_matches(host, '(^|[.-])(casino|bets|pills|adult|ads)([.-]|$)')
                     then 'block' else 'allow' end) as verdict
from parts left join (select * from fit where k = 1) f using (page_id)
"""


@query("op10_url_filter", _URL_SQL)
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host = url_filter.host_of(F.col("url"))
    blocklist = pages.select(host.alias("host")).filter(F.col("host").rlike(SPAM_HOST)).distinct()
    judged = url_filter.judge_urls(pages, URL_RULES, blocklist)
    return judged.select("page_id", "host", "path", "rule", "verdict")
