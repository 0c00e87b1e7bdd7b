"""Explicit schemas and the fixed value tables shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

SEGMENTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("seq", T.StringType()),
        T.StructField("LN", T.LongType()),
        T.StructField("SN", T.StringType()),
        T.StructField("SO", T.LongType()),
        T.StructField("SR", T.IntegerType()),
    ]
)
LINKS = T.StructType(
    [
        T.StructField("from_seg", T.StringType()),
        T.StructField("from_orient", T.StringType()),
        T.StructField("to_seg", T.StringType()),
        T.StructField("to_orient", T.StringType()),
        T.StructField("overlap", T.StringType()),
        T.StructField("SR", T.IntegerType()),
        T.StructField("L1", T.StringType()),
        T.StructField("L2", T.StringType()),
    ]
)
INTERVALS = T.StructType(
    [
        T.StructField("chrom", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("cCRE_acc", T.StringType()),
        T.StructField("RDHS_id", T.StringType()),
        T.StructField("cCRE_class", T.StringType()),
    ]
)
LINKS_REQUIRED = [f.name for f in LINKS.fields[:5]]
SEGMENTS_REQUIRED = [f.name for f in SEGMENTS.fields]

# --- fixed values -----------------------------------------------------------
# Regulatory element classes: position in the list is the integer label.
ELEMENT_CLASSES = [
    "background",
    "PLS",
    "pELS",
    "dELS",
    "CA-CTCF",
    "CA-H3K4me3",
    "CA-TF",
    "TF",
    "CA",
]
# A higher priority wins when two classes cover the same number of bases.
ELEMENT_PRIORITY = {
    "PLS": 100,
    "pELS": 90,
    "dELS": 80,
    "CA-CTCF": 70,
    "CA-H3K4me3": 60,
    "CA-TF": 50,
    "TF": 40,
    "CA": 30,
    "background": 0,
}
POPULATIONS = ["AFR", "AMR", "EAS", "EUR", "SAS", "UNK", "REF"]
CANONICAL_CHROMS = [f"chr{i}" for i in range(1, 23)] + ["chrX", "chrY"]
PAPER_CHROMS = ["chr16", "chr8", "chr19", "chr22"]
GENOME_LENGTH_BP = 3.2e9
META_KEYS = [
    "type",
    "target_sn",
    "start",
    "end",
    "window_bp",
    "closure",
    "n_segments",
    "n_links",
]
# --- end of fixed values ------------------------------------------------------
