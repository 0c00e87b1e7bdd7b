"""URL verdicts through a cascade of Bloom filters, without joins.

Rules are (host, path) pairs; a rule fits its host and all subdomains when the
URL's path starts with the rule's path, and the longest fitting rule decides.
A URL has few candidate keys: its host suffixes times the path prefixes of the
lengths that rules have. The complete key universe of the corpus, every distinct
candidate key of every URL, is known, so membership in the rule list can be made
exact: level 0 encodes the listed keys, level 1 the universe keys that pass level 0
wrongly, level 2 the listed keys that pass level 1 wrongly, and so on until a level
has no false positives. A key is listed if the first level it misses is odd.

URLs that no rule fits get the method's verdict in the same way: the registered
host (and its parents) is looked up in a cascade over the block list.

Filters are built with bit_or over 64-bit words, so only the bits reach the
driver. The listed keys are split by hash into parts of at most `part_keys`, each
with its own cascade of bounded size; a key is answered by the part of its hash.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbraid.llm.common import map_arrow, materialise, ready
from seqbraid.llm.textnp import mix

PART_KEYS = 4_000_000
MAX_LEVELS = 64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """The host and its parents, longest first: a.b.c, b.c, c. None for an empty host."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    suffixes = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), ".")
    )
    return F.when(F.length(host) > 0, suffixes).otherwise(F.array().cast("array<string>"))


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Host suffix + path prefix for every rule path length, longest key first."""
    prefixes = F.filter(
        F.array(*[F.substring(path, 1, n) for n in sorted(path_lengths, reverse=True)])
        if path_lengths
        else F.array().cast("array<string>"),
        lambda p: p.isNotNull(),
    )
    fits = F.array_distinct(
        F.filter(prefixes, lambda p: F.length(p).isin(*path_lengths) if path_lengths else F.lit(False))
    )
    keys = F.flatten(F.transform(host_suffixes(host), lambda h: F.transform(fits, lambda p: F.concat(h, p))))
    return F.array_sort(
        keys,
        lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a))
        .when(a < b, F.lit(-1))
        .when(a > b, F.lit(1))
        .otherwise(F.lit(0)),
    )


@dataclass
class Level:
    bits: np.ndarray
    size: int
    probes: int
    salt: int


@dataclass
class Cascade:
    """Alternating filters of one part of the keys."""

    levels: list[Level]

    @property
    def nbytes(self) -> int:
        return sum(level.bits.nbytes for level in self.levels)


def _sizing(n: int, rate: float) -> tuple[int, int]:
    size = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64) * 64)
    return size, max(1, round(-math.log2(rate)))


def _probes(h: np.ndarray, level_salt: int, i: int, size: int) -> np.ndarray:
    salt = np.uint64((level_salt * 1000 + i) * 0x9E3779B97F4A7C15 % (1 << 64))
    return mix(h ^ salt) % np.uint64(size)


def _holds(level: Level, h: np.ndarray) -> np.ndarray:
    hit = np.ones(len(h), bool)
    for i in range(level.probes):
        at = _probes(h, level.salt, i, level.size)
        hit &= (level.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return hit


def _build(keys: DataFrame, size: int, probes: int, salt: int) -> Level:
    """The filter's bits: OR-ed in every task, then across tasks; size / 64 rows in the end."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at = np.concatenate([_probes(h, salt, i, size) for i in range(probes)])
            word, where = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, where, np.uint64(1) << (at & np.uint64(63)))
            return pa.record_batch([word.astype(np.int64), bits.view(np.int64)], ["w", "bits"])

        return each

    words = (
        map_arrow(keys.select("h"), make, "w long, bits long")
        .groupBy("w")
        .agg(F.bit_or("bits").alias("bits"))
        .toPandas()
    )
    bits = np.zeros(size // 64, np.int64)
    bits[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return Level(bits.view(np.uint64), size, probes, salt)


def _passes(keys: DataFrame, level: Level) -> DataFrame:
    """The keys for which the filter says yes."""
    shared = keys.sparkSession.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def inside(h: pd.Series) -> pd.Series:
        return pd.Series(_holds(shared.value, h.to_numpy(np.int64).view(np.uint64)))

    return keys.filter(inside("h"))


def build_cascade(listed: DataFrame, others: DataFrame) -> Cascade:
    """A cascade over two disjoint tables with a column `h` of distinct key hashes."""
    levels: list[Level] = []
    inside, outside = listed, others
    n_in, n_out = inside.count(), outside.count()
    while n_in:
        if len(levels) >= MAX_LEVELS:
            raise RuntimeError("key hashes of listed and other keys collide")
        # The first level keeps about as many false positives as there are listed keys.
        rate = min(0.5, 0.7 * n_in / max(n_out, 1)) if not levels else 0.5
        size, probes = _sizing(n_in, max(rate, 1e-9))
        level = _build(inside, size, probes, len(levels) + 1)
        levels.append(level)
        wrong = materialise(_passes(outside, level))
        inside, outside = wrong, inside
        n_in, n_out = wrong.count(), n_in
    return Cascade(levels)


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (mix(h) >> np.uint64(20)) % np.uint64(parts)


def cascades(listed: DataFrame, universe: DataFrame, part_keys: int = PART_KEYS) -> list[Cascade]:
    """One cascade for each part of the key hashes; `h` of both tables must be distinct."""
    ready(listed.sparkSession)
    listed = materialise(listed.select("h").join(universe.select("h"), "h", "left_semi"))
    parts = max(1, math.ceil(listed.count() / part_keys))
    others = materialise(universe.select("h").join(listed, "h", "left_anti"))
    if parts == 1:
        return [build_cascade(listed, others)]

    @F.pandas_udf("long")
    def part(h: pd.Series) -> pd.Series:
        return pd.Series(_part_of(h.to_numpy(np.int64).view(np.uint64), parts).astype(np.int64))

    return [
        build_cascade(listed.filter(part("h") == i), others.filter(part("h") == i))
        for i in range(parts)
    ]


def key_hash(key: Column) -> Column:
    return F.xxhash64(key)


def is_listed(filters: list[Cascade], spark: SparkSession) -> Callable[[Column], Column]:
    """A column function from an array of key hashes to an array of booleans.

    The answer is exact for every key of the universe that the filters were built on.
    """
    ready(spark)
    shared = spark.sparkContext.broadcast(filters)

    def decide(h: np.ndarray) -> np.ndarray:
        answer = np.zeros(len(h), bool)
        part = _part_of(h, len(shared.value))
        for p, cascade in enumerate(shared.value):
            rows = np.flatnonzero(part == p)
            for depth, level in enumerate(cascade.levels):
                rows = rows[_holds(level, h[rows])]
                # Those that pass belong to the set that this level encodes, for now.
                answer[rows] = depth % 2 == 0
        return answer

    @F.pandas_udf("array<boolean>")
    def member(hashes: pd.Series) -> pd.Series:
        if not len(hashes):
            return pd.Series([], dtype=object)
        cuts = np.cumsum([len(x) for x in hashes])[:-1]
        flat = np.concatenate([np.asarray(x, np.int64) for x in hashes]).view(np.uint64)
        return pd.Series([x.tolist() for x in np.split(decide(flat), cuts)])

    return lambda hashes: member(hashes)


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    blocklist: DataFrame,
    part_keys: int = PART_KEYS,
) -> DataFrame:
    """`pages` with host, path, rule, verdict and listed_host.

    `rules` are (verdict, host, path), a short hand-written list. `blocklist` has a
    column `host`: hosts that are blocked, with all their subdomains, where no rule
    fits. `listed_host` is the longest block-listed parent of the host, else null.
    A null URL, or one without ://, has an empty host and path, no candidate keys,
    and is allowed. Repeated URLs get the same verdict. Columns of the five result
    names are replaced; others pass through.
    """
    spark = pages.sparkSession
    ready(spark)
    lengths = sorted({len(path) for _, _, path in rules})
    base = pages.drop("host", "path", "rule", "verdict", "listed_host")
    base = base.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    ids = base.select("host", "path").distinct()
    keys = ids.select(F.explode(candidate_keys(F.col("host"), F.col("path"), lengths)).alias("key"))
    hosts = ids.select("host").distinct()
    names = hosts.select(F.explode(host_suffixes(F.col("host"))).alias("key"))
    # Rule keys hold a path, block-list keys are marked as hosts, in one universe.
    mark = F.concat(F.lit("host:"), F.col("key"))
    universe = materialise(
        keys.select(key_hash(F.col("key")).alias("h"))
        .unionByName(names.select(key_hash(mark).alias("h")))
        .distinct()
    )
    rule_keys = spark.createDataFrame([(h + p,) for _, h, p in rules], "key string")
    listed = (
        rule_keys.select(key_hash(F.col("key")).alias("h"))
        .unionByName(blocklist.select(F.col("host").alias("key")).select(key_hash(mark).alias("h")))
        .distinct()
    )
    member = is_listed(cascades(listed, universe, part_keys), spark)

    candidates = candidate_keys(F.col("host"), F.col("path"), lengths)
    parents = host_suffixes(F.col("host"))
    asked = base.withColumn("_keys", candidates).withColumn("_hosts", parents)
    hashed = F.concat(
        F.transform("_keys", lambda k: key_hash(k)),
        F.transform("_hosts", lambda k: key_hash(F.concat(F.lit("host:"), k))),
    )
    answered = asked.withColumn("_hashes", hashed).withColumn("_in", member(F.col("_hashes")))
    n_keys = F.size("_keys")
    rule = F.get(F.filter("_keys", lambda _, i: F.get("_in", i)), F.lit(0))
    host = F.get(F.filter("_hosts", lambda _, i: F.get("_in", i + n_keys)), F.lit(0))
    verdict_of = F.create_map(*[F.lit(x) for v, h, p in rules for x in (h + p, v)])
    return (
        answered.withColumn("rule", rule)
        .withColumn("listed_host", host)
        .withColumn(
            "verdict",
            F.when(F.col("rule").isNotNull(), F.element_at(verdict_of, F.col("rule")))
            .when(F.col("listed_host").isNotNull(), "block")
            .otherwise("allow"),
        )
        .drop("_keys", "_hosts", "_hashes", "_in")
    )
