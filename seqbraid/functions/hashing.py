"""A portable draw, so sampling depends on data and seed only.

Any SQL engine has MD5, so the same draw can be recomputed elsewhere, and the
result does not depend on partitioning, task order or retries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_DIGITS = 15  # hexadecimal digits kept, so a draw lies in [0, 2^60)
DRAW_RANGE = 1 << (4 * DRAW_DIGITS)


def draw(seed: int, *keys: Column | str) -> Column:
    """A non-negative integer from the seed and the text form of the keys."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *keys))
    return F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("long")


def keep_fraction(drawn: Column, fraction: float) -> Column:
    """True for about `fraction` of all draws."""
    return drawn < F.lit(int(fraction * DRAW_RANGE))
