"""Expressions over contig, chromosome, sample and node names."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbraid.schemas import CANONICAL_CHROMS, PAPER_CHROMS, POPULATIONS


def _last(text: Column, mark: str) -> Column:
    return F.element_at(F.split(text, "[" + mark + "]"), -1)


def oriented_id(segid: Column, orient: Column) -> Column:
    """2 * segid, plus 1 on the reverse strand; null when the segment is unknown."""
    return segid * 2 + F.when(orient == "-", 1).otherwise(0)


def segment_of(oid: Column) -> Column:
    return F.shiftright(oid, 1)


def strand_bit(oid: Column) -> Column:
    return oid.bitwiseAND(F.lit(1).cast("long")).cast("int")


def strand_char(oid: Column) -> Column:
    return F.when(oid % 2 == 0, "+").otherwise("-")


def is_reference(sr: Column, sn: Column) -> Column:
    """1 for rank 0 or a contig of a reference assembly, whichever spelling."""
    by_name = sn.startswith("GRCh38") | sn.startswith("CHM13") | sn.startswith("id=CHM13")
    return F.when((sr == 0) | by_name, 1).otherwise(0)


def normalize_chrom(name: Column) -> Column:
    """chr22 and GRCh38#0#chr22 both become chr22; other names keep their last # part."""
    return F.when(name.startswith("chr"), name).otherwise(_last(name, "#"))


def normalize_chrom_text(name: str) -> str:
    """`normalize_chrom` for a constant."""
    return name if name.startswith("chr") else name.rpartition("#")[2]


def contig_chrom(sn: Column) -> Column:
    """The chromosome of a contig name, null when the name does not show one."""
    tail = _last(sn, "#")
    return F.when(sn.startswith("chr"), sn).when(
        sn.contains("#") & tail.startswith("chr"), tail
    )


def report_chrom(sn: Column) -> Column:
    """Short chromosome name for reports: after the last #, then after the last |."""
    return _last(_last(sn, "#"), "|")


def contigs_of_chroms(contigs: DataFrame, chroms: DataFrame, reference_only: bool = True) -> DataFrame:
    """(chrom, SN) pairs for contigs whose chromosome is listed in `chroms`."""
    named = contigs.select("SN", contig_chrom(F.col("SN")).alias("chrom")).distinct()
    if reference_only:
        named = named.filter(F.col("SN").startswith("GRCh38"))
    return named.join(chroms.select("chrom").distinct(), "chrom")


def sample_id(sn: Column) -> Column:
    """HG002#1#chr1, HG002.1.chr1 and HG002 all give HG002."""
    return F.when(sn.contains("#"), F.split(sn, "#")[0]).otherwise(F.split(sn, "[.]")[0])


def population_index(contigs: DataFrame, populations: DataFrame, sn: str = "SN") -> DataFrame:
    """Add `pop_idx`: the reference, the sample's listed population, or unknown.

    `populations` has one row per sample (sample_id, pop_idx).
    """
    sample = sample_id(F.col(sn))
    reference = sample.startswith("GRCh38") | sample.startswith("CHM13")
    listed = populations.select(
        F.col("sample_id").alias("_sample"), F.col("pop_idx").alias("_listed")
    )
    return (
        contigs.withColumn("_sample", sample)
        .join(listed, "_sample", "left")
        .withColumn(
            "pop_idx",
            F.when(reference, F.lit(POPULATIONS.index("REF"))).otherwise(
                F.coalesce("_listed", F.lit(POPULATIONS.index("UNK")))
            ),
        )
        .drop("_sample", "_listed")
    )


def segid_from_label(raw: Column) -> Column:
    """s123 or 123 gives 123, anything else null."""
    return F.regexp_extract(raw, "^s?([0-9]+)$", 1).try_cast("long")


def slice_name(target: Column, start: Column, end: Column, closure: Column) -> Column:
    """File-safe text for people; different slices may share it, see `slice_id`."""
    safe = F.regexp_replace(target, "[#/ ]", "_")
    return F.substring(F.concat_ws("_", F.lit("slice"), safe, start, end, closure), 1, 120)


def slice_id(target: Column, start: Column, end: Column, closure: Column) -> Column:
    """The key of a slice: a hash of its window and closure as they are, never shortened."""
    parts = F.concat_ws("|", start, end, closure, target)
    return F.concat(F.lit("slice_"), F.md5(parts))


# --- fixed values -----------------------------------------------------------
TARGET_PRESETS = {
    "all": CANONICAL_CHROMS,
    "all-canonical": CANONICAL_CHROMS,
    "canonical": CANONICAL_CHROMS,
    "ccre-paper": PAPER_CHROMS,
    "paper-ccre": PAPER_CHROMS,
}
# A name with one of these is a full contig name.
FULL_NAME = r"[#|]|^id="
# A prefix that ends in one of these is joined as it is, any other with a #.
PREFIX_ENDS = r"[#|:/_-]$"
# --- end of fixed values ------------------------------------------------------


def contig_name(name: Column, prefix: str | None) -> Column:
    """The contig of a chromosome under a prefix or a pattern with {}."""
    if not prefix:
        return name
    pattern = prefix if "{}" in prefix else prefix + "{}"
    if "{}" not in prefix and not re.search(PREFIX_ENDS, prefix):
        pattern = prefix + "#{}"
    named = F.replace(F.lit(pattern), F.lit("{}"), name)
    return F.when(name.rlike(FULL_NAME), name).otherwise(named)


def targets_table(spark: SparkSession, names: Iterable[str], prefix: str | None = None) -> DataFrame:
    """SN, in the order asked for: presets replaced by their chromosomes, then named by contig."""
    asked = spark.createDataFrame(list(enumerate(names)), "at int, name string")
    preset = spark.createDataFrame(
        [(key, i, chrom) for key, chroms in TARGET_PRESETS.items() for i, chrom in enumerate(chroms)],
        "preset string, i int, chrom string",
    )
    return (
        asked.join(F.broadcast(preset), F.lower("name") == F.col("preset"), "left")
        .orderBy("at", "i")
        .select(contig_name(F.coalesce("chrom", "name"), prefix).alias("SN"))
    )
