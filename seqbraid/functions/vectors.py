"""Array-column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqbraid.schemas import GENOME_LENGTH_BP


def pair_interaction(u: Column, v: Column) -> Column:
    """[u, v, u*v, |u-v|] as one array, the input of a pair scorer."""
    product = F.zip_with(u, v, lambda a, b: a * b)
    gap = F.zip_with(u, v, lambda a, b: F.abs(a - b))
    return F.concat(u, v, product, gap)


def sinusoidal_encoding(offset: Column, dim: int = 64, base: float = 10_000.0) -> Column:
    """Interleaved sine and cosine of the genome-scaled offset at dim/2 frequencies."""
    position = offset.cast("double") / F.lit(GENOME_LENGTH_BP)
    waves = []
    for i in range(dim // 2):
        angle = position * F.lit(base ** (-2.0 * i / dim))
        waves += [F.sin(angle).cast("float"), F.cos(angle).cast("float")]
    return F.array(*waves)


def adaptive_window(
    branching: Column, base: int = 32, alpha: float = 4.0, low: int = 32, high: int = 256
) -> Column:
    """Window size that grows with the share of branching nodes, kept in [low, high]."""
    grown = F.floor(F.lit(base) * (F.lit(1.0) + F.lit(alpha) * branching))
    return F.greatest(F.lit(low), F.least(F.lit(high), grown)).cast("int")
