"""Key lookups that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbraid.session import broadcast_limit, estimated_bytes, materialise, scanned_bytes

# Below this input size no single key can be more than a task can carry.
CHECK_BYTES = 256 << 20
# A key is hot from this many rows on, so there are at most rows/HOT_ROWS hot keys.
HOT_ROWS = 2_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than `hot_rows` rows; map-side counting keeps this skew-free."""
    return df.groupBy(*keys).count().filter(F.col("count") > hot_rows).select(*keys)


def cuts_hot_keys(spark: SparkSession) -> bool:
    """Whether adaptive execution cuts a shuffled partition that a hot key has filled."""
    return all(
        spark.conf.get(f"spark.sql.adaptive.{key}", "true").lower() == "true"
        for key in ("enabled", "skewJoin.enabled")
    )


def attach(
    df: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    check_bytes: int = CHECK_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join `df` to `lookup`, which has one row, or a few, per key.

    A lookup below the broadcast threshold, or a `df` whose scans are below `check_bytes`,
    is a plain join. So is any other where adaptive execution cuts what a hot key has filled:
    it sees the rows once they are shuffled, while counting them here first would run all
    that lies below `df` twice. Without it rows of hot keys are split off and meet their few
    lookup rows by broadcast; the number of those is bounded by rows/hot_rows.
    `how` may be inner, left, left_semi or left_anti.
    """
    keys = list(keys)
    spark = df.sparkSession
    size = scanned_bytes(df)
    small = size is not None and size <= check_bytes
    if estimated_bytes(lookup) <= broadcast_limit(spark) or small or cuts_hot_keys(spark):
        return df.join(lookup, keys, how)
    hot = materialise(hot_keys(df, keys, hot_rows))
    if hot.isEmpty():
        return df.join(lookup, keys, how)
    hot_lookup = materialise(lookup.join(F.broadcast(hot), keys, "left_semi"))
    hot_part = df.join(F.broadcast(hot), keys, "left_semi")
    cold_part = df.join(F.broadcast(hot), keys, "left_anti")
    return hot_part.join(F.broadcast(hot_lookup), keys, how).unionByName(
        cold_part.join(lookup, keys, how)
    )
