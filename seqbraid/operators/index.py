"""Dense segment ids, link endpoints and oriented metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqbraid.functions.names import is_reference, oriented_id
from seqbraid.operators.ordering import with_position
from seqbraid.operators.skew import attach


def segment_index(segments: DataFrame) -> DataFrame:
    """One row per name, the one with the lowest id, numbered 0.. in id order as `segid`."""
    rest = [c for c in segments.columns if c != "name"]
    first = segments.groupBy("name").agg(F.min_by(F.struct(*rest), "id").alias("_row"))
    return with_position(first.select("name", "_row.*"), ["id"], name="segid")


def map_links(links: DataFrame, index: DataFrame) -> DataFrame:
    """Add from_id, to_id and the oriented ids u, v; null where a name is unknown."""
    names = index.select("name", "segid")
    sides = links
    for name, ident in (("from_seg", "from_id"), ("to_seg", "to_id")):
        side = names.select(F.col("name").alias(name), F.col("segid").alias(ident))
        sides = attach(sides, side, [name])
    return sides.select(
        *links.columns,
        "from_id",
        "to_id",
        oriented_id(F.col("from_id"), F.col("from_orient")).alias("u"),
        oriented_id(F.col("to_id"), F.col("to_orient")).alias("v"),
    )


def known_links(links: DataFrame, index: DataFrame) -> DataFrame:
    """Links whose two names both exist."""
    names = index.select("name").distinct()
    kept = attach(links, names.withColumnRenamed("name", "from_seg"), ["from_seg"], "left_semi")
    return attach(kept, names.withColumnRenamed("name", "to_seg"), ["to_seg"], "left_semi")


def unknown_endpoints(links: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct link endpoint names that no segment has."""
    ends = links.select(F.explode(F.array("from_seg", "to_seg")).alias("name")).distinct()
    return ends.join(index.select("name"), "name", "left_anti")


def require_known(links: DataFrame, index: DataFrame) -> DataFrame:
    """`links` unchanged, or an error that shows some unknown endpoint names."""
    missing = [r.name for r in unknown_endpoints(links, index).orderBy("name").limit(5).collect()]
    if missing:
        raise ValueError(f"link endpoints without a segment, for example {missing}")
    return links


def oriented_metadata(index: DataFrame) -> DataFrame:
    """Two rows per segment: SN, SO, LN, SR and the reference flag keyed by oid."""
    return index.select(
        F.explode(F.array(F.col("segid") * 2, F.col("segid") * 2 + 1)).alias("oid"),
        "SN",
        "SO",
        "LN",
        "SR",
        is_reference(F.col("SR"), F.col("SN")).alias("is_reference"),
    )


def link_ends(links: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Both ends of every link as `oid`, in one pass."""
    return links.select(*keys, F.explode(F.array("u", "v")).alias("oid"))


def oriented_degree(links: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Ends per oriented node; a self-loop counts twice."""
    return link_ends(links, keys).groupBy(*keys, "oid").agg(F.count("*").alias("degree"))


def oriented_nodes(links: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return link_ends(links, keys).distinct()


def positive_pairs(links: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct ordered pairs; the reverse of a pair is a different pair."""
    return links.select(*keys, "u", "v").distinct()


def segment_degree(links: DataFrame, index: DataFrame) -> DataFrame:
    """Degree of both strands together, 0 for segments without a link."""
    counts = (
        link_ends(links)
        .groupBy(F.shiftright("oid", 1).alias("segid"))
        .agg(F.count("*").alias("degree"))
    )
    return index.select("segid").join(counts, "segid", "left").na.fill(0, ["degree"])
