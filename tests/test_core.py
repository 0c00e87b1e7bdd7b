"""Ordering, skew and adjacency against plain computations."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from frames import rows
from seqbraid.operators import ordering, skew
from seqbraid.operators.adjacency import Adjacency
from seqbraid.operators.ordering import running_sums, with_frames, with_position
from seqbraid.operators.skew import attach, hot_keys
from seqbraid.session import (
    _FACTOR_KEY,
    MEMORY_FACTOR,
    broadcast_limit,
    estimated_bytes,
    materialise,
    plan_by_memory,
    scanned_bytes,
)


@pytest.fixture(scope="module")
def hot(spark):
    """900 rows, a third of them in one group, with tied values."""
    rng = random.Random(3)
    data = [("hot" if i % 3 == 0 else f"g{rng.randrange(40)}", rng.randrange(50), i) for i in range(900)]
    return data, spark.createDataFrame(data, "g string, x long, i long").repartition(5)


def _sorted_groups(data):
    out = {}
    for g, x, i in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(g, []).append((x, i))
    return out


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_positions_and_sums(spark, hot, partitions):
    data, df = hot
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = {r.i: r.pos for r in with_position(df, ["x", "i"], ["g"]).collect()}
        summed = {r.i: r.s for r in running_sums(df, ["x", "i"], ["g"], {"s": F.col("x")}).collect()}
        whole = {r.i: r.pos for r in with_position(df, [F.desc("x"), "i"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for group in _sorted_groups(data).values():
        total = 0
        for n, (x, i) in enumerate(group):
            total += x
            assert ranked[i] == n and summed[i] == total
    order = sorted(data, key=lambda r: (-r[1], r[2]))
    assert [whole[r[2]] for r in order] == list(range(len(data)))


def test_frames_cross_blocks(hot):
    data, df = hot
    frames = {
        "prev": lambda w: F.lag("x").over(w),
        "next": lambda w: F.lead("x").over(w),
        "mean": lambda w: F.avg("x").over(w.rowsBetween(-2, 2)),
    }
    got = {r.i: r for r in with_frames(df, ["x", "i"], ["g"], 2, frames, block_rows=7).collect()}
    assert len(got) == len(data)
    for group in _sorted_groups(data).values():
        xs = [x for x, _ in group]
        for n, (_, i) in enumerate(group):
            near = xs[max(0, n - 2) : n + 3]
            assert got[i].prev == (xs[n - 1] if n else None)
            assert got[i].next == (xs[n + 1] if n + 1 < len(xs) else None)
            assert abs(got[i].mean - sum(near) / len(near)) < 1e-9


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_key_join_equals_plain_join(spark, hot, how):
    _, df = hot
    lookup = df.select("g").distinct().filter("g <> 'g3'").withColumn("v", F.length("g"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        split = attach(df, lookup, ["g"], how, check_bytes=0, hot_rows=100)
        assert sorted(rows(split), key=str) == sorted(rows(df.join(lookup, ["g"], how)), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hub_salts_do_not_change_neighbours(spark):
    links = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(1, 40)] + [(5, 5)]
    df = spark.createDataFrame(links, "u long, v long")
    plain, salted = Adjacency.build(df), Adjacency.build(df, check_bytes=0, hub_rows=8)
    assert plain.hubs is None and salted.hubs is not None
    front = spark.createDataFrame([(0, "a"), (5, "b"), (39, "c")], "node long, tag string")
    assert sorted(rows(salted.expand(front).select("dst", "tag"))) == sorted(
        rows(plain.expand(front).select("dst", "tag"))
    )


def test_join_gets_no_more_ranges_than_the_session_shuffles_into(spark, tmp_path):
    """The planner multiplies the sides of an equi-join; the ranges follow the scans."""
    path = str(tmp_path / "rows")
    spark.range(10_000).withColumn("text", F.repeat(F.lit("x"), 200)).write.parquet(path)
    side = spark.read.parquet(path)
    joined = side.join(side.withColumnRenamed("text", "other").hint("merge"), "id")
    assert estimated_bytes(joined) > 100 * scanned_bytes(joined)
    assert ordering._range_count(joined) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_tables_are_planned_at_their_size_in_memory(spark):
    """The file is below the broadcast limit, its rows are not."""
    name = F.concat(F.lit("slice_"), F.md5((F.col("id") % 8).cast("string"))).alias("slice_id")
    table = materialise(spark.range(400_000).select(name, F.col("id").alias("oid")))
    assert scanned_bytes(table) < broadcast_limit(spark) < 400_000 * 50
    joined = table.withColumn("x", F.lit(1)).join(table, ["slice_id", "oid"])
    assert "Broadcast" not in joined._jdf.queryExecution().sparkPlan().toString()


def test_views_set_the_size_in_memory_where_the_session_has_none(spark):
    bare = spark.newSession()
    bare.conf.set(_FACTOR_KEY, "1.0")
    plan_by_memory(bare)
    assert float(bare.conf.get(_FACTOR_KEY)) == MEMORY_FACTOR
    bare.conf.set(_FACTOR_KEY, "3.0")
    plan_by_memory(bare)
    assert bare.conf.get(_FACTOR_KEY) == "3.0"


def test_lookup_does_not_count_its_rows_where_spark_cuts_hot_keys(spark, hot, monkeypatch):
    """Counting keys first would run all that lies below the rows once more for every lookup."""
    _, df = hot
    lookup = df.select("g").distinct().withColumn("v", F.length("g"))
    counted = []
    monkeypatch.setattr(skew, "hot_keys", lambda *a: counted.append(1) or hot_keys(*a))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        plain = attach(df, lookup, ["g"], check_bytes=0, hot_rows=100)
        assert not counted
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
        split = attach(df, lookup, ["g"], check_bytes=0, hot_rows=100)
        assert counted and sorted(rows(split)) == sorted(rows(plain))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")


def test_positions_leave_the_sorted_rows_where_they_lie(spark):
    df = spark.range(300_000).select((F.col("id") * 7919 % 300_007).alias("x"), "id", F.lit("t").alias("dropped"))
    placed = with_position(df, ["x"], name="pos", keep=["id"])
    assert placed.columns == ["id", "pos"]
    plan = placed._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
