"""Positions, running sums and short frames over one long order.

A window partitioned by contig, slice or group puts a hot group into one task.
Everything here instead range-partitions on (group, order), works inside each
range, and adds per-range offsets. A group that holds a third of the rows is
simply spread over a third of the ranges. `order` must be unique per group, so
that ranges can always be cut; the ranges are written once, because sampling
the range bounds twice could cut them differently.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqbraid.operators.skew import attach
from seqbraid.session import materialise, scanned_bytes

RANGE_BYTES = 128 << 20
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _range_count(df: DataFrame) -> int:
    """A range for every RANGE_BYTES of input, at least as many as the session shuffles into."""
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffle, -(-(scanned_bytes(df) or 0) // RANGE_BYTES))


def _ranges(
    df: DataFrame, order: Sequence[Column | str], keep: Sequence[str] | None = None
) -> DataFrame:
    """Globally sorted rows with `_range` (which range) and `_at` (row within it).

    Only the columns `keep` are written, by default all.
    """
    keep = list(keep or df.columns)
    placed = (
        df.repartitionByRange(_range_count(df), *order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    return materialise(placed.select(*keep, "_row")).select(
        *keep,
        F.shiftright("_row", _ROW_BITS).alias("_range"),
        F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_at"),
    )


def with_position(
    df: DataFrame,
    order: Sequence[Column | str],
    group: Sequence[str] = (),
    name: str = "pos",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add the 0-based position in `order`, counted from 0 in every `group`.

    Group columns must not be null. `keep` names the columns still wanted, the group's among
    them; by default all stay.
    """
    keep = list(keep or df.columns)
    rows = _ranges(df, [*group, *order], keep)
    keys = ["_range", *group]
    # Written, so that the planner knows how few they are and leaves the rows where they lie.
    heads = materialise(
        rows.groupBy(*keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    )
    # One row per (range, group): for a hot group at most the number of ranges.
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(
        *keys, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return attach(rows, heads, keys, how="inner").select(
        *keep, (F.col("_at") + F.col("_shift")).alias(name)
    )


def running_sums(
    df: DataFrame,
    order: Sequence[Column | str],
    group: Sequence[str],
    sums: dict[str, Column],
) -> DataFrame:
    """Add inclusive running sums along `order` within each `group`."""
    rows = _ranges(df, [*group, *order])
    keys = ["_range", *group]
    inside = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys).agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    offsets = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    local = rows.select("*", *[F.sum(e).over(inside).alias(f"_l_{n}") for n, e in sums.items()])
    return attach(local, offsets, keys, how="inner").select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums]
    )


def with_frames(
    df: DataFrame,
    order: Sequence[Column | str],
    group: Sequence[str],
    reach: int,
    frames: dict[str, Callable[[Window], Column]],
    block_rows: int = 100_000,
    keep: Sequence[str] | None = None,
    name: str | None = None,
) -> DataFrame:
    """Evaluate lag, lead and row frames of at most `reach` rows along `order`.

    Rows are cut into blocks of `block_rows` consecutive positions, the `reach`
    rows on each side are copied into the neighbouring block, and the window
    runs per block. `frames` maps a column name to a function of the window. `keep` are the
    columns still wanted after the sort, and `name` is the position's, if it is wanted too.
    """
    keep = list(keep or df.columns)
    rows = with_position(df, order, group, "_pos", keep)

    def block_of(shift: int) -> Column:
        return F.floor((F.col("_pos") + shift) / block_rows)

    copies = rows.withColumn(
        "_block", F.explode(F.array_distinct(F.array(block_of(-reach), block_of(0), block_of(reach))))
    ).filter("_block >= 0")
    frame = Window.partitionBy(*group, "_block").orderBy("_pos")
    return (
        copies.select("*", *[make(frame).alias(n) for n, make in frames.items()])
        .filter(F.col("_block") == block_of(0))
        .select(*keep, *([F.col("_pos").alias(name)] if name else []), *frames)
    )
