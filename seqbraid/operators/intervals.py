"""Interval overlap: per-class base pairs, dominant class, window membership.

Sums and counts never build overlapping pairs. With sorted boundaries, the base
pairs that intervals of one class share with [a, b) are C(b) - C(a), where

    C(x) = sum over starts s <= x of (x - s)  -  sum over ends e <= x of (x - e)

is a running sum. A pile of intervals on one spot, a very long interval or a
contig with a third of the rows therefore costs no more than any other row.
Where the pairs themselves are wanted, both sides meet in hierarchical bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbraid.functions.names import contig_chrom
from seqbraid.operators.ordering import running_sums
from seqbraid.operators.skew import attach
from seqbraid.schemas import ELEMENT_CLASSES, ELEMENT_PRIORITY
from seqbraid.session import materialise, materialise_counted

CLASSES = [c for c in ELEMENT_CLASSES if c != "background"]


def class_table(spark: SparkSession) -> DataFrame:
    rows = [(i, c, ELEMENT_PRIORITY[c]) for i, c in enumerate(ELEMENT_CLASSES)]
    return spark.createDataFrame(rows, "ccre_label int, ccre_class string, priority int")


def overlaps_window(so: Column, ln: Column, start: Column, end: Column) -> Column:
    """Half-open overlap; a zero-length segment strictly inside counts."""
    return (so < end) & (so + ln > start)


def contig_intervals(index: DataFrame, target: str) -> DataFrame:
    """(segid, SO, END) of one contig, without the sort that only a local sweep needs."""
    return index.filter(F.col("SN") == target).select(
        "segid", "SO", (F.col("SO") + F.col("LN")).alias("END")
    )


def class_overlap_wide(intervals: DataFrame, segments: DataFrame) -> DataFrame:
    """Per segment one array of base pairs per class, in class order without background.

    `segments` has segid, chrom, SO, LN. Intervals of one class add up even
    where they overlap each other; empty intervals and segments share nothing.
    """
    code = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("cCRE_class")).cast("int") - 1
    boundary = F.explode(
        F.array(
            F.struct(F.col("start").alias("at"), F.lit(1).alias("step")),
            F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")),
        )
    )
    steps = (
        intervals.filter("end > start")
        .select("chrom", code.alias("code"), boundary.alias("b"))
        # Boundaries on the same spot collapse here, before anything is sorted.
        .groupBy("chrom", "code", F.col("b.at").alias("at"))
        .agg(F.sum("b.step").alias("step"))
        .filter("step <> 0")
        .select("chrom", "at", "code", "step", F.lit(None).cast("long").alias("segid"), F.lit(0).alias("sign"))
    )
    probe = F.explode(
        F.array(
            F.struct(F.col("SO").alias("at"), F.lit(-1).alias("sign")),
            F.struct((F.col("SO") + F.col("LN")).alias("at"), F.lit(1).alias("sign")),
        )
    )
    probes = (
        segments.filter("LN > 0")
        .select("chrom", "segid", probe.alias("p"))
        .select(
            "chrom",
            "p.at",
            F.lit(-1).alias("code"),
            F.lit(0).cast("long").alias("step"),
            "segid",
            "p.sign",
        )
    )
    sums: dict[str, Column] = {}
    for i in range(len(CLASSES)):
        sums[f"n{i}"] = F.expr(f"if(code = {i}, step, 0L)")
        sums[f"x{i}"] = F.expr(f"if(code = {i}, step * at, 0L)")
    placed = running_sums(
        steps.unionByName(probes), ["at", "segid", "sign", "code"], ["chrom"], sums
    )
    covered = [F.expr(f"sum(sign * (at * n{i} - x{i})) as b{i}") for i in range(len(CLASSES))]
    bp = placed.filter("segid is not null").groupBy("segid").agg(*covered)
    return bp.select("segid", F.array(*[f"b{i}" for i in range(len(CLASSES))]).alias("class_bp"))


def class_overlaps(intervals: DataFrame, segments: DataFrame) -> DataFrame:
    """(segid, ccre_class, overlap_bp) for every class that shares bases with a segment."""
    names = F.array(*map(F.lit, CLASSES))
    return (
        class_overlap_wide(intervals, segments)
        .select("segid", F.posexplode("class_bp").alias("_i", "overlap_bp"))
        .filter("overlap_bp > 0")
        .select("segid", F.get(names, F.col("_i")).alias("ccre_class"), "overlap_bp")
    )


def dominant(class_bp: Column) -> tuple[Column, Column, Column, Column]:
    """(class, total bp, dominant bp, number of classes) from an array of class bp."""
    table = ", ".join(
        f"struct({ELEMENT_PRIORITY[c]} as priority, '{c}' as name)" for c in CLASSES
    )
    ranked = F.array_max(
        F.zip_with(
            F.coalesce(class_bp, F.expr(f"array_repeat(0L, {len(CLASSES)})")),
            F.expr(f"array({table})"),
            lambda bp, c: F.struct(
                bp.alias("bp"), c["priority"].alias("priority"), c["name"].alias("name")
            ),
        )
    )
    any_bp = ranked["bp"] > 0
    total = F.coalesce(F.aggregate(class_bp, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0))
    touching = F.coalesce(F.size(F.filter(class_bp, lambda x: x > 0)), F.lit(0))
    return (
        F.when(any_bp, ranked["name"]).otherwise("background"),
        total.cast("long"),
        F.when(any_bp, ranked["bp"]).otherwise(0).cast("long"),
        F.when(any_bp, touching).otherwise(0).cast("int"),
    )


def reference_segments(index: DataFrame, intervals: DataFrame) -> DataFrame:
    """Segments of GRCh38 contigs on chromosomes that the interval table covers."""
    chroms = intervals.select("chrom").distinct()
    named = index.filter(F.col("SN").startswith("GRCh38")).select(
        "segid", "SN", contig_chrom(F.col("SN")).alias("chrom"), "SO", "LN"
    )
    return attach(named, chroms, ["chrom"], "left_semi")


def node_labels(intervals: DataFrame, index: DataFrame) -> DataFrame:
    """One row per reference segment with its dominant class, background included."""
    segments = reference_segments(index, intervals)
    wide = class_overlap_wide(intervals, segments)
    name, total, best, touching = dominant(F.col("class_bp"))
    labels = F.create_map(*[F.lit(x) for i, c in enumerate(ELEMENT_CLASSES) for x in (c, i)])
    return (
        segments.join(wide, "segid", "left")
        .select(
            "segid",
            (F.col("segid") * 2).alias("oid_fwd"),
            (F.col("segid") * 2 + 1).alias("oid_rev"),
            "SN",
            "chrom",
            "SO",
            "LN",
            name.alias("ccre_class"),
            total.alias("overlap_bp"),
            best.alias("dominant_class_overlap_bp"),
            touching.alias("n_ccres_touching"),
        )
        .withColumn("ccre_label", labels[F.col("ccre_class")])
    )


def require_rows(labels: DataFrame) -> DataFrame:
    if labels.isEmpty():
        raise RuntimeError("no reference segment matches a chromosome of the interval table")
    return labels


def class_crosstab(labels: DataFrame) -> DataFrame:
    """chrom x class counts in class order, zeros filled, with a TOTAL column."""
    wide = labels.groupBy("chrom").pivot("ccre_class", ELEMENT_CLASSES).count().na.fill(0)
    total = sum((F.col(f"`{c}`") for c in ELEMENT_CLASSES[1:]), F.col(ELEMENT_CLASSES[0]))
    return wide.withColumn("TOTAL", total)


def label_summary(labels: DataFrame) -> DataFrame:
    """Count per class, zeros included, with the overall labelled share and chromosomes."""
    spark = labels.sparkSession
    counts = labels.groupBy("ccre_class").agg(F.count("*").alias("n"))
    overall = labels.agg(
        F.avg((F.col("ccre_class") != "background").cast("double")).alias("frac_labeled_nonbg"),
        F.array_sort(F.collect_set("chrom")).alias("chroms_covered"),  # one entry per chromosome
    )
    return (
        class_table(spark)
        .join(counts, "ccre_class", "left")
        .select("ccre_label", "ccre_class", F.coalesce("n", F.lit(0)).alias("n"))
        .join(F.broadcast(overall), how="cross")  # a single row
    )


# Bins of one level are this many times as wide as those of the level below. Wider steps
# put an interval among more others that it does not meet.
BIN_STEP = 2
LEVELS = 46
BIN_WIDTH = 4096
# A bin with more intervals of one side is split over several tasks.
BIN_ROWS = 500_000
# So is one with more comparisons, into a grid of pieces of both sides; a join gets a partition
# for each so many of them.
BIN_PAIRS = 20_000_000
MOST_PARTS = 1 << 16


def _last(start: Column, end: Column) -> Column:
    return F.greatest(start, end - 1)


def _level(start: Column, end: Column, bin_width: int) -> Column:
    """The lowest level whose bins are no narrower than the interval."""
    length = _last(start, end) - start + 1
    out = F.lit(LEVELS - 1)
    for level in range(LEVELS - 2, -1, -1):
        out = F.when(length <= bin_width * BIN_STEP**level, level).otherwise(out)
    return out


def _in_bins(df: DataFrame, start: str, end: str, levels: Column, bin_width: int) -> DataFrame:
    """A row for every bin that an interval meets at each of some levels, two at most per level."""
    width = F.lit(bin_width) * F.pow(F.lit(BIN_STEP), F.col("_level")).cast("long")
    wide = df.withColumn("_level", F.explode(levels)).withColumn("_width", width)
    first = F.floor(F.col(start) / F.col("_width"))
    last = F.floor(_last(F.col(start), F.col(end)) / F.col("_width"))
    return wide.withColumn("_bin", F.explode(F.sequence(first, last)))


def _pieces(rows: DataFrame, hot: DataFrame, on: list[str], own: str, other: str) -> DataFrame:
    """`rows` of one side dealt into the pieces of their bin, each repeated for those of the other side."""
    own_count, other_count = (F.coalesce(c, F.lit(1).cast("long")) for c in (own, other))
    place = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in on]), own_count)
    every = F.explode(F.sequence(F.lit(0).cast("long"), other_count - 1))
    dealt = attach(rows, hot, on).withColumn(f"_at{own}", place)
    return dealt.withColumn(f"_at{other}", every).drop(own, other)


def overlap_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    bin_width: int = BIN_WIDTH,
    bin_rows: int = BIN_ROWS,
    bin_pairs: int = BIN_PAIRS,
) -> DataFrame:
    """All overlapping pairs of rows with columns `start`, `end` on equal `keys`.

    The output has the columns of both sides, the right bounds renamed to r_start and r_end.
    Bins are hierarchical: an interval is at home on the lowest level whose bins hold its
    length, in the one or two bins that it meets there, however long it is. Of two that
    overlap, the one of the lower (or an equal) level looks the other up in its home bins, so
    it is compared on the levels that the other side uses and on no more. A pair is kept only
    in the bin where its later start lies, so nothing is repeated. Both sides of a bin are
    counted, and one of more than `bin_rows` home intervals or `bin_pairs` comparisons is
    split: pieces of one side meet pieces of the other, so many of each that the fewest rows
    are repeated, which grow with the root of the comparisons. There is a partition for every
    `bin_pairs` comparisons, so that a task does about as many however the pairs grow; only
    their number grows with the result.
    """
    spark = left.sparkSession
    b = right.withColumnRenamed("start", "r_start").withColumnRenamed("end", "r_end")
    own_a = _level(F.col("start"), F.col("end"), bin_width)
    own_b = _level(F.col("r_start"), F.col("r_end"), bin_width)
    on = [*keys, "_level", "_bin"]
    later = F.greatest("start", "r_start")

    def used(df: DataFrame, own: Column) -> list[int]:
        return sorted(r[0] for r in df.select(own.alias("l")).distinct().collect())  # at most LEVELS

    def matched(home: DataFrame, probe: DataFrame) -> DataFrame:
        both = home.groupBy(*on).agg(F.count("*").alias("_h")).join(
            probe.groupBy(*on).agg(F.count("*").alias("_p")), on
        )
        work = F.col("_h").cast("double") * F.col("_p")
        split = F.greatest(F.ceil(F.col("_h") / bin_rows), F.least("_h", F.ceil(work / bin_pairs)))
        # A home row goes to every piece of the probes and a probe to every piece of the home rows.
        even = F.round(F.sqrt(split * F.col("_h") / F.col("_p"))).cast("long")
        own = F.greatest(F.least(even, split), F.ceil(F.col("_h") / bin_rows))
        grid = both.select(*on, own.alias("_home"), work.alias("_w"), split.alias("_split"), "_p")
        other = F.least("_p", F.ceil(F.col("_split") / F.col("_home")))
        bins, seen = materialise_counted(grid.select(*on, "_home", other.alias("_probe"), "_w"), all=F.sum("_w"))
        hot = materialise(bins.filter("_home > 1 or _probe > 1").select(*on, "_home", "_probe"))
        join_on = on
        if not hot.isEmpty():
            home, probe = _pieces(home, hot, on, "_home", "_probe"), _pieces(probe, hot, on, "_probe", "_home")
            join_on = [*on, "_at_home", "_at_probe"]
        # Adaptive execution merges partitions by the bytes that go in; what counts here is the
        # number of comparisons, so a partition for each `bin_pairs` of them is asked for.
        parts = min(MOST_PARTS, int((seen["all"] or 0) // bin_pairs))
        if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
            home, probe = home.repartition(parts, *join_on), probe.repartition(parts, *join_on)
        return (
            home.drop("_width")
            .join(probe, join_on)
            .filter((F.col("start") < F.col("r_end")) & (F.col("end") > F.col("r_start")))
            .filter(F.col("_bin") == F.floor(later / F.col("_width")))
            .select(*left.columns, *[c for c in b.columns if c not in keys])
        )

    def levels(side: list[int], own: Column, equal: bool) -> Column:
        return F.filter(
            F.array(*map(F.lit, side)), lambda level: (level >= own) if equal else (level > own)
        )

    levels_a, levels_b = used(left, own_a), used(b, own_b)
    low_a = matched(
        _in_bins(b, "r_start", "r_end", F.array(own_b), bin_width),
        _in_bins(left, "start", "end", levels(levels_b, own_a, True), bin_width),
    )
    if not any(i > j for i in levels_a for j in levels_b):
        return low_a
    low_b = matched(
        _in_bins(left, "start", "end", F.array(own_a), bin_width),
        _in_bins(b, "r_start", "r_end", levels(levels_a, own_b, False), bin_width),
    )
    return low_a.unionByName(low_b)


def window_core(
    windows: DataFrame, index: DataFrame, bin_width: int = BIN_WIDTH, bin_rows: int = BIN_ROWS
) -> DataFrame:
    """(slice_id, segid) of every segment that overlaps a window of its contig.

    `windows` has slice_id, target_sn, start, end.
    """
    segs = index.select(
        F.col("SN").alias("target_sn"),
        "segid",
        F.col("SO").alias("start"),
        (F.col("SO") + F.col("LN")).alias("end"),
    )
    wins = windows.select("slice_id", "target_sn", "start", "end")
    near = attach(segs, wins.select("target_sn").distinct(), ["target_sn"], "left_semi")
    return overlap_pairs(near, wins, ["target_sn"], bin_width, bin_rows).select("slice_id", "segid")


def overlap_counts(windows: DataFrame, index: DataFrame) -> DataFrame:
    """Segments per window as (starts before the end) - (ends up to the start).

    `windows` has window_id, target_sn, start, end; windows without a segment get 0.
    """
    zero = F.lit(0).cast("long")
    segs = index.select(
        F.col("SN").alias("target_sn"),
        F.explode(
            F.array(
                F.struct(F.col("SO").alias("at"), F.lit(1).alias("opens")),
                F.struct((F.col("SO") + F.col("LN")).alias("at"), F.lit(0).alias("opens")),
            )
        ).alias("b"),
    )
    # Boundaries on one spot collapse to a counter each before the sort.
    segs = attach(segs, windows.select("target_sn").distinct(), ["target_sn"], "left_semi")
    events = (
        segs.groupBy("target_sn", "b.at")
        .agg(F.sum("b.opens").alias("starts"), F.sum(1 - F.col("b.opens")).alias("ends"))
        .select("target_sn", "at", F.lit(1).alias("rank"), "starts", "ends", F.lit(None).cast(windows.schema["window_id"].dataType).alias("window_id"), zero.alias("sign"))
    )
    # A window's end sees starts before it (rank 0, sorted first on its spot);
    # its start sees ends up to and including it (rank 2, sorted last).
    probe = F.explode(
        F.array(
            F.struct(F.col("end").alias("at"), F.lit(0).alias("rank"), F.lit(1).cast("long").alias("sign")),
            F.struct(F.col("start").alias("at"), F.lit(2).alias("rank"), F.lit(-1).cast("long").alias("sign")),
        )
    )
    probes = windows.select("target_sn", "window_id", probe.alias("p")).select(
        "target_sn", "p.at", "p.rank", zero.alias("starts"), zero.alias("ends"), "window_id", "p.sign"
    )
    sums = {"opened": F.col("starts"), "closed": F.col("ends")}
    placed = running_sums(events.unionByName(probes), ["at", "rank", "window_id"], ["target_sn"], sums)
    seen = F.when(F.col("sign") == 1, F.col("opened")).otherwise(-F.col("closed"))
    return placed.filter("window_id is not null").groupBy("window_id").agg(F.sum(seen).alias("n_core"))
