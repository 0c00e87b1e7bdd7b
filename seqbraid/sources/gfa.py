"""GFA/rGFA text as segment and link tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbraid.operators.ordering import running_sums
from seqbraid.operators.skew import attach
from seqbraid.session import materialise, materialise_counted

# Rows of three numbers that are sent to every task at most: file blocks, and words of lines.
BLOCK_ROWS = 4_000_000
WORD_ROWS = 4_000_000


def _scan(spark: SparkSession, path: str) -> DataFrame:
    return scan_schema(spark.read.text(path))


def scan_schema(text: DataFrame) -> DataFrame:
    """Text lines with the file block they come from, in scan order."""
    return text.select(
        "value",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
    )


def _number_blocks(lines: DataFrame, name: str) -> DataFrame:
    """Number rows along (path, block, row in block) without shuffling a row.

    `lines` comes straight from `_scan`, at most filtered. It is scanned once, into a
    columnar copy that keeps each row's block and place, so the numbers cannot depend on a
    second scan that might cut the files differently. Only the row count of every block is
    gathered and ordered, and sent back to all tasks: one row for each block of a file.
    """
    rows = materialise(
        lines.select(
            "value",
            F.xxhash64("_path").alias("_file"),
            "_path",
            "_start",
            F.monotonically_increasing_id().alias("_place"),
        )
    )
    block = ["_path", "_start"]
    sizes = rows.groupBy(*block, "_file").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    ended = running_sums(sizes, block, [], {"_upto": F.col("_n")})
    shifts = ended.select("_file", "_start", (F.col("_upto") - F.col("_n") - F.col("_first")).alias("_shift"))
    return rows.join(_small(shifts, BLOCK_ROWS), ["_file", "_start"]).select(
        "value", (F.col("_place") + F.col("_shift")).alias(name)
    )


def _small(table: DataFrame, limit: int) -> DataFrame:
    """`table`, written, and marked for broadcast if it has at most `limit` (narrow) rows."""
    table, seen = materialise_counted(table)
    return F.broadcast(table) if seen["rows"] <= limit else table


def read_lines(spark: SparkSession, path: str, max_lines: int | None = None) -> DataFrame:
    """Lines of plain or gzip text as `value`, with `line_no` in file order."""
    lines = _number_blocks(_scan(spark, path), "line_no")
    if max_lines is not None:
        lines = lines.filter(F.col("line_no") < max_lines)
    return lines


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segment table of a whole file; `id` counts S records in line order.

    Same rows as `segments_of`, but ids come from per-block counts, so that the
    sequences are never shuffled.
    """
    return numbered_segments(_scan(spark, path))


def numbered_segments(scanned: DataFrame) -> DataFrame:
    """Segment table of scanned lines, ids counted along their files."""
    # At least three fields: the mark, a tab, and one more tab further on.
    kept = scanned.filter(F.col("value").like("S\t%\t%"))
    return _number_blocks(kept, "id").select("id", *segment_columns(F.split("value", "\t")))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Link table of a whole file; no order is needed, so lines are not numbered."""
    return links_of(split_records(spark.read.text(path)))


def split_records(lines: DataFrame) -> DataFrame:
    """Keep record lines (comments dropped) with their tab fields and record type."""
    fields = F.split("value", "\t")
    keep = [c for c in lines.columns if c != "value"]
    return lines.filter(~F.col("value").startswith("#")).select(
        *keep, fields.alias("fields"), fields[0].alias("kind")
    )


def tag_value(fields: Column, first: int, key: str) -> Column:
    """Value of the last KEY:TYPE:VALUE tag from 1-based field `first` on; null if absent.

    VALUE may itself contain colons.
    """
    tags = F.slice(fields, first, F.greatest(F.size(fields) - (first - 1), F.lit(0)))
    hits = F.filter(tags, lambda t: t.rlike(f"^{key}:[^:]*:"))
    return F.regexp_extract(F.try_element_at(hits, F.lit(-1)), "^[^:]*:[^:]*:((?s).*)$", 1)


def to_int(text: Column, default: Column | int = 0) -> Column:
    """Integer value of a tag, or the default when missing, empty or not a number."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.trim(text).try_cast("long"), default.cast("long"))


def is_segment(kind: Column, fields: Column) -> Column:
    return (kind == "S") & (F.size(fields) >= 3)


def is_link(kind: Column, fields: Column) -> Column:
    return (kind == "L") & (F.size(fields) >= 6)


def segment_columns(fields: Column) -> list[Column]:
    """Segment table columns except `id`, with the tag defaults."""
    seq = fields[2]
    own_length = F.when(seq == "*", 0).otherwise(F.length(seq))
    return [
        fields[1].alias("name"),
        seq.alias("seq"),
        to_int(tag_value(fields, 4, "LN"), own_length).alias("LN"),
        F.coalesce(tag_value(fields, 4, "SN"), F.lit("")).alias("SN"),
        to_int(tag_value(fields, 4, "SO")).alias("SO"),
        to_int(tag_value(fields, 4, "SR")).cast("int").alias("SR"),
    ]


def link_columns(fields: Column) -> list[Column]:
    return [
        fields[1].alias("from_seg"),
        fields[2].alias("from_orient"),
        fields[3].alias("to_seg"),
        fields[4].alias("to_orient"),
        fields[5].alias("overlap"),
        to_int(tag_value(fields, 7, "SR")).cast("int").alias("SR"),
        F.coalesce(tag_value(fields, 7, "L1"), F.lit("")).alias("L1"),
        F.coalesce(tag_value(fields, 7, "L2"), F.lit("")).alias("L2"),
    ]


def _chosen(records: DataFrame, lines: DataFrame, name: str) -> DataFrame:
    """The records whose line_no stands in `lines`, with their place among those lines.

    The chosen lines are put into words of 64 bits with the number of chosen ones before
    each. Up to WORD_ROWS words meet the records by broadcast, so no text is shuffled;
    more meet them by a join on the word.
    """
    bit = F.expr("shiftleft(1L, cast(line_no & 63 as int))")
    below = F.expr("~shiftleft(-1L, cast(line_no & 63 as int))")
    words = lines.groupBy(F.shiftright("line_no", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    words = words.withColumn("_n", F.bit_count("_bits").cast("long"))
    ended = running_sums(words, ["_word"], [], {"_upto": F.col("_n")})
    ended = ended.select("_word", "_bits", (F.col("_upto") - F.col("_n")).alias("_before"))
    placed = records.withColumn("_word", F.shiftright("line_no", 6)).join(_small(ended, WORD_ROWS), "_word")
    return placed.filter(F.col("_bits").bitwiseAND(bit) != 0).select(
        *records.columns,
        (F.col("_before") + F.bit_count(F.col("_bits").bitwiseAND(below))).alias(name),
    )


def segments_of(records: DataFrame) -> DataFrame:
    """Segment table of any record selection; `id` counts its S records in line order."""
    kind, fields = F.col("kind"), F.col("fields")
    kept = records.filter(is_segment(kind, fields))
    return _chosen(kept, kept.select("line_no"), "id").select("id", *segment_columns(fields))


def links_of(records: DataFrame) -> DataFrame:
    kind, fields = F.col("kind"), F.col("fields")
    keep = [c for c in records.columns if c == "line_no"]
    return records.filter(is_link(kind, fields)).select(*keep, *link_columns(fields))


def parse_stats(lines: DataFrame) -> DataFrame:
    """One row of counters over the physical lines, comment lines included."""
    fields = F.split("value", "\t")
    record = ~F.col("value").startswith("#")
    kind = F.when(record, fields[0])
    segment = is_segment(kind, fields)

    def missing(key: str) -> Column:
        return segment & tag_value(fields, 4, key).isNull()

    return lines.agg(
        F.count("*").alias("lines_read"),
        F.count_if(segment).alias("segments"),
        F.count_if(is_link(kind, fields)).alias("links"),
        F.count_if(kind == "P").alias("paths"),
        F.count_if(kind == "W").alias("walks"),
        F.count_if(segment & (F.coalesce(tag_value(fields, 4, "SN"), F.lit("")) == "")).alias(
            "segments_missing_sn"
        ),
        F.count_if(missing("SO")).alias("segments_missing_so"),
        F.count_if(missing("SR")).alias("segments_missing_sr"),
    )


def _followed(
    records: DataFrame, targets: DataFrame, include_link_neighbors: bool, *extra: Column | str
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(target names, kept names, kept segments, kept links) from names alone; sequences are
    not touched. Kept rows have kind, a, b, SN and what `extra` takes from their records."""
    kind, fields = F.col("kind"), F.col("fields")
    segment = is_segment(kind, fields)
    # A narrow copy: every further pass reads names instead of parsing the text again.
    parsed = materialise(
        records.filter(segment | is_link(kind, fields)).select(
            *extra,
            "kind",
            fields[1].alias("a"),
            F.when(kind == "L", fields[3]).alias("b"),
            F.when(segment, F.coalesce(tag_value(fields, 4, "SN"), F.lit(""))).alias("SN"),
        )
    )
    segment_rows, link_rows = parsed.filter("kind = 'S'"), parsed.filter("kind = 'L'")
    hits = materialise(
        segment_rows.join(targets.select("SN").distinct(), "SN", "left_semi")
        .select(F.col("a").alias("name"))
        .distinct()
    )
    kept = hits
    if include_link_neighbors:
        ends = link_rows.select("a", "b")
        a_hit = attach(ends, hits.withColumnRenamed("name", "a"), ["a"], "left_semi")
        b_hit = attach(ends, hits.withColumnRenamed("name", "b"), ["b"], "left_semi")
        # The end that is hit stands among the hits, where a name only links bear cannot be.
        kept = materialise(hits.union(a_hit.select("b")).union(b_hit.select("a")).distinct())
    of_a, of_b = kept.withColumnRenamed("name", "a"), kept.withColumnRenamed("name", "b")
    segments = attach(segment_rows, of_a, ["a"], "left_semi")
    links = attach(attach(link_rows, of_a, ["a"], "left_semi"), of_b, ["b"], "left_semi")
    return hits, kept, segments, links


def _closure(
    records: DataFrame, targets: DataFrame, include_link_neighbors: bool
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(target names, kept names, kept lines)."""
    hits, kept, segments, links = _followed(records, targets, include_link_neighbors, "line_no")
    narrow = ["line_no", "kind"]
    return hits, kept, materialise(segments.select(*narrow).unionByName(links.select(*narrow)))


def targeted_records(
    records: DataFrame, targets: DataFrame, include_link_neighbors: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(target names, kept names, kept records) for the contigs listed in `targets` (SN).

    With neighbours, both ends of every link that touches a target name are
    kept too. A segment stays when its name is kept, a link when both ends are.
    Whole records are fetched in a second scan by their line numbers.
    """
    hits, kept, lines = _closure(records, targets, include_link_neighbors)
    return hits, kept, _chosen(records, lines, "_at").select(*records.columns)


def targeted_tables(
    records: DataFrame, targets: DataFrame, include_link_neighbors: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(segments, links) of a targeted parse, with all their columns; ids count kept segments."""
    _, _, lines = _closure(records, targets, include_link_neighbors)
    fields = F.col("fields")
    segments, links = (
        _chosen(records, lines.filter(F.col("kind") == kind).select("line_no"), "id") for kind in "SL"
    )
    return segments.select("id", *segment_columns(fields)), links.select(*link_columns(fields))


def targeted_stats(
    lines: DataFrame, records: DataFrame, targets: DataFrame, include_link_neighbors: bool = False
) -> DataFrame:
    """`parse_stats` for a targeted parse, with the target and kept-name counters.

    Kept records are counted by their names and two flags, so neither needs line numbers.
    """
    absent = [tag_value(F.col("fields"), 4, key).isNull().alias(f"no_{key}") for key in ("SO", "SR")]
    hits, kept, segments, links = _followed(records, targets, include_link_neighbors, *absent)
    one_row = [
        parse_stats(lines).select("lines_read", "paths", "walks"),
        segments.agg(
            F.count("*").alias("segments"),
            F.count_if(F.col("SN") == "").alias("segments_missing_sn"),
            F.count_if("no_SO").alias("segments_missing_so"),
            F.count_if("no_SR").alias("segments_missing_sr"),
        ),
        links.agg(F.count("*").alias("links")),
        targets.agg(F.countDistinct("SN").alias("target_sns")),
        hits.agg(F.count("*").alias("target_segments")),
        kept.agg(F.count("*").alias("kept_segment_names")),
    ]
    out = one_row[0]
    for row in one_row[1:]:  # single-row tables, side by side
        out = out.join(row, how="cross")
    return out.select(
        "lines_read",
        "paths",
        "walks",
        "segments",
        "links",
        "segments_missing_sn",
        "segments_missing_so",
        "segments_missing_sr",
        "target_sns",
        "target_segments",
        "kept_segment_names",
        F.lit(int(include_link_neighbors)).alias("include_link_neighbors"),
    )


def to_gfa_lines(segments: DataFrame, links: DataFrame) -> DataFrame:
    """Write both tables back as GFA text lines (`value`), segments with all four tags."""
    s = segments.select(
        F.concat_ws(
            "\t",
            F.lit("S"),
            "name",
            "seq",
            F.concat(F.lit("LN:i:"), "LN"),
            F.concat(F.lit("SN:Z:"), "SN"),
            F.concat(F.lit("SO:i:"), "SO"),
            F.concat(F.lit("SR:i:"), "SR"),
        ).alias("value")
    )
    link_fields = ["from_seg", "from_orient", "to_seg", "to_orient", "overlap"]
    return s.union(links.select(F.concat_ws("\t", F.lit("L"), *link_fields).alias("value")))
