"""Chromosome splits and per-slice splits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqbraid.functions.hashing import DRAW_DIGITS, draw
from seqbraid.functions.names import normalize_chrom, normalize_chrom_text
from seqbraid.operators.ordering import with_position
from seqbraid.operators.skew import attach
from seqbraid.session import materialise

# The hashes of a slice are counted in 2 ** CELL_BITS cells.
CELL_BITS = 12


def split_table(spark: SparkSession, **chroms: Iterable[str] | None) -> DataFrame:
    """(chrom, split) of the chromosomes listed for every split, normalised, each once."""
    rows = [(split, str(c)) for split, listed in chroms.items() for c in listed or ()]
    table = spark.createDataFrame(rows, "split string, name string")
    return table.select(normalize_chrom(F.col("name")).alias("chrom"), "split").distinct()


def shared_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys that both tables have."""
    return a.select(*keys).intersect(b.select(*keys))


def split_overlaps(table: DataFrame, key: str = "chrom") -> DataFrame:
    """(key, splits) of the keys that stand in more than one split."""
    splits = table.groupBy(key).agg(F.sort_array(F.collect_set("split")).alias("splits"))
    return splits.filter(F.size("splits") > 1)


def require_split(table: DataFrame, *needed: str) -> None:
    """Raise if a chromosome has two splits, or a needed split has none. The lists are short."""
    twice = {r.chrom: r.splits for r in split_overlaps(table).limit(100).collect()}
    if twice:
        raise ValueError(f"chromosomes in more than one split: {dict(sorted(twice.items()))}")
    present = {r.split for r in table.select("split").distinct().collect()}
    if set(needed) - present:
        raise ValueError(f"no chromosome is listed for {sorted(set(needed) - present)}")


def chrom_split(chrom: Column, val: Iterable[str], test: Iterable[str]) -> Column:
    """test, val or train by chromosome; a chromosome in both lists is an error."""
    held = {"val": {*map(normalize_chrom_text, val)}, "test": {*map(normalize_chrom_text, test)}}
    if held["val"] & held["test"]:
        raise ValueError(f"chromosomes for both val and test: {sorted(held['val'] & held['test'])}")
    name = normalize_chrom(chrom)
    return F.coalesce(*[F.when(name.isin(*c), s) for s, c in held.items() if c], F.lit("train"))


def missing_targets(requested: DataFrame, available: DataFrame) -> DataFrame:
    """Requested contigs (SN) that the data does not have."""
    return requested.select("SN").distinct().join(available.select("SN"), "SN", "left_anti")


def require_targets(requested: DataFrame, available: DataFrame) -> None:
    absent = sorted(r.SN for r in missing_targets(requested, available).limit(100).collect())
    if absent:
        raise ValueError(f"requested targets are not in the data: {absent}")


def slice_split(
    edges: DataFrame,
    order: list[str],
    seed: int = 42,
    test_share: float = 0.2,
    val_share: float = 0.1,
    min_train: int = 10,
) -> DataFrame:
    """Per-slice test/val/train split in hash order; slices with few train rows dropped.

    `order` are columns that together identify a row of a slice. Where test and val end is
    found without sorting the rows: hashes are counted in cells, and only the cells that hold
    the last rows of a split are ranked. Every row is then held against the two marks of its slice.
    """
    hashed = materialise(edges.withColumn("_h", draw(seed, "slice_id", *order)))
    cell = F.shiftright("_h", 4 * DRAW_DIGITS - CELL_BITS).cast("int")
    cells = materialise(hashed.groupBy("slice_id", cell.alias("_cell")).agg(F.count("*").alias("_n")))
    sizes = cells.groupBy("slice_id").agg(F.sum("_n").alias("_n"))
    n_test = F.floor(F.col("_n") * F.lit(test_share))
    n_val = F.floor(F.col("_n") * F.lit(val_share))
    sizes = sizes.select("slice_id", n_test.alias("_a"), (n_test + n_val).alias("_b"), "_n")
    usable = materialise(sizes.filter(F.col("_n") - F.col("_b") >= min_train))
    # At most 2 ** CELL_BITS rows of a slice.
    before = Window.partitionBy("slice_id").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    asked = placed.join(usable.drop("_n"), "slice_id")
    inside = [
        (F.col(mark) >= F.col("_before")) & (F.col(mark) < F.col("_before") + F.col("_n"))
        for mark in ("_a", "_b")
    ]
    asked = materialise(asked.filter(inside[0] | inside[1]).drop("_n"))
    near = hashed.withColumn("_cell", cell).select("slice_id", "_cell", "_h", *order)
    near = attach(near, asked.select("slice_id", "_cell"), ["slice_id", "_cell"], "left_semi")
    ranked = with_position(near, ["_h", *order], ["slice_id", "_cell"], "_rank")
    ranked = ranked.join(asked, ["slice_id", "_cell"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    key = F.struct("_h", *order)
    ends = ranked.groupBy("slice_id").agg(
        *[F.min(F.when(F.col("_rank") == F.col(mark), key)).alias(f"_at{mark}") for mark in ("_a", "_b")]
    )
    marks = materialise(usable.select("slice_id").join(ends, "slice_id", "left"))

    def below(mark: str) -> Column:
        """Before the first row that is not of the split; a split that ends its slice has no such row."""
        return F.col(mark).isNull() | (key < F.col(mark))

    return attach(hashed, marks, ["slice_id"], "inner").select(
        *edges.columns,
        F.when(below("_at_a"), "test").when(below("_at_b"), "val").otherwise("train").alias("split"),
    )


def filter_manifest(
    manifest: DataFrame,
    closure: str = "all",
    split: str = "all",
    max_slices: int | None = None,
    order: str = "slice_id",
) -> DataFrame:
    """Manifest rows of a closure and split; an empty result is an error."""
    out = manifest
    if closure != "all":
        out = out.filter(F.col("closure") == closure)
    if split != "all" and "split" in manifest.columns:
        out = out.filter(F.col("split") == split)
    if max_slices is not None:
        out = out.orderBy(order).limit(max_slices)
    if out.isEmpty():
        raise RuntimeError(f"no manifest rows for closure={closure!r}, split={split!r}")
    return out


def covered_segments(
    slice_segments: DataFrame,
    manifest: DataFrame,
    labels: DataFrame,
    closures: Iterable[str],
    split: str = "all",
    val: Iterable[str] = (),
    test: Iterable[str] = (),
) -> DataFrame:
    """Labelled segids that occur in a slice of the chosen closures and split."""
    chosen = manifest.filter(F.col("closure").isin(list(closures)))
    if split != "all":
        chosen = chosen.filter(chrom_split(F.col("target_sn"), val, test) == split)
    inside = attach(
        slice_segments.select("slice_id", "segid"),
        chosen.select("slice_id").distinct(),
        ["slice_id"],
        "left_semi",
    )
    return attach(
        inside.select("segid").distinct(), labels.select("segid").distinct(), ["segid"], "left_semi"
    )
