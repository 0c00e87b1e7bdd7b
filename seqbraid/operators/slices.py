"""Coordinate windows, induced subgraphs and slice checks, for all windows at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqbraid.functions.hashing import draw
from seqbraid.functions.names import slice_id, slice_name
from seqbraid.operators.index import oriented_metadata
from seqbraid.operators.intervals import overlap_counts, window_core
from seqbraid.operators.ordering import with_position
from seqbraid.operators.sampling import (
    NegativeRule,
    balanced_edges,
    rejected_slices,
    sample_negatives,
    slice_codes,
)
from seqbraid.operators.skew import attach
from seqbraid.schemas import META_KEYS
from seqbraid.session import materialise, materialise_counted

ATTEMPTS_PER_WINDOW = 15


def grid_windows(index: DataFrame, targets: Column, window_bp: int, closure: str) -> DataFrame:
    """Every non-empty window of a fixed grid on the contigs that meet `targets`."""
    start = F.floor(F.col("SO") / window_bp) * window_bp
    return (
        index.filter(targets)
        .select(F.col("SN").alias("target_sn"), start.alias("start"))
        .distinct()
        .withColumn("end", F.col("start") + window_bp)
        .withColumn("closure", F.lit(closure))
        .withColumn(
            "slice_id", slice_id(F.col("target_sn"), F.col("start"), F.col("end"), F.col("closure"))
        )
    )


def choose_windows(
    index: DataFrame,
    attempts: DataFrame,
    window_bp: int,
    seed: int = 42,
    max_tries: int = 300,
    prefer_dense: bool = True,
) -> DataFrame:
    """One window per row of `attempts` (target_sn, attempt): the densest of `max_tries`.

    A try starts at a hash-chosen segment of the contig minus a hash-chosen
    shift below `window_bp`, so it may be negative. Ties go to the first try.
    Without `prefer_dense` the first non-empty try is taken.
    """
    near = attach(
        index.select(F.col("SN").alias("target_sn"), "SO", "segid"),
        attempts.select("target_sn").distinct(),
        ["target_sn"],
        "left_semi",
    )
    ranked = materialise(with_position(near, ["SO", "segid"], ["target_sn"], "rank"))
    sizes = ranked.groupBy("target_sn").agg(F.count("*").alias("n"))
    drawn = (
        attempts.join(sizes, "target_sn")
        .withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(max_tries - 1))))
        .withColumn("rank", draw(seed, "target_sn", "attempt", "try", F.lit("at")) % F.col("n"))
        .withColumn(
            "shift", draw(seed, "target_sn", "attempt", "try", F.lit("shift")) % F.lit(window_bp)
        )
    )
    tries = materialise(
        drawn.join(ranked, ["target_sn", "rank"]).select(
            "target_sn",
            "attempt",
            "try",
            (F.col("SO") - F.col("shift")).alias("start"),
            F.struct("target_sn", "attempt", "try").alias("window_id"),
        )
    ).withColumn("end", F.col("start") + window_bp)
    counted = overlap_counts(tries, index).select("window_id.*", "n_core").filter("n_core > 0")
    best = F.struct("n_core", -F.col("try")) if prefer_dense else F.struct(-F.col("try"))
    picked = counted.groupBy("target_sn", "attempt").agg(
        F.max_by(F.struct("try", "n_core"), best).alias("p")
    )
    return (
        picked.select("target_sn", "attempt", "p.try", "p.n_core")
        .join(tries, ["target_sn", "attempt", "try"])
        .select("target_sn", "attempt", "start", "end", "n_core")
    )


def _coded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a short `_slice` for slice_id, the codes): ids are long texts to shuffle."""
    ids = rows.select("slice_id").distinct()
    codes = materialise(with_position(ids, ["slice_id"], name="_slice")).select(
        "slice_id", F.col("_slice").cast("int").alias("_slice")
    )
    return attach(rows, codes, ["slice_id"], "inner").select("_slice", "segid"), codes


def _touched(links: DataFrame, coded: DataFrame) -> DataFrame:
    """(_slice, segid) of both ends of all links that touch a core, with repeats."""
    pairs = links.select("from_id", "to_id")
    near = [
        attach(pairs, coded.withColumnRenamed("segid", end), [end], "inner").select(
            "_slice", F.explode(F.array("from_id", "to_id")).alias("segid")
        )
        for end in ("from_id", "to_id")
    ]
    return near[0].union(near[1])


def touched_segments(links: DataFrame, core: DataFrame) -> DataFrame:
    """(slice_id, segid) of both ends of all links that touch a core (slice_id, segid)."""
    coded, codes = _coded(core)
    near = _touched(links, coded).distinct()
    return attach(near, codes, ["_slice"], "inner").select("slice_id", "segid")


def links_inside(links: DataFrame, kept: DataFrame) -> DataFrame:
    """Links whose two segments are kept in the same slice.

    A link meets the set of slices of each end and is repeated only for those in both, so
    that no row is made for a slice that keeps one end alone.
    """
    coded, codes = _coded(kept)
    return _inside(links, coded, codes)


def touched_edges(links: DataFrame, core: DataFrame) -> DataFrame:
    """slice_id, link_id, u, v of the links inside the one-hop slices of `core`.

    The rows of `links_inside` for `touched_segments`, without names and without a table of
    kept segments: a segment's set of slices needs no distinct rows.
    """
    coded, codes = _coded(core)
    narrow = links.select("link_id", "from_id", "to_id", "u", "v")
    return _inside(narrow, _touched(links, coded), codes).select("slice_id", "link_id", "u", "v")


def _inside(links: DataFrame, coded: DataFrame, codes: DataFrame) -> DataFrame:
    """`links_inside` for (_slice, segid), which may hold repeats."""
    held = materialise(coded.groupBy("segid").agg(F.collect_set("_slice").alias("_s")))
    ends = attach(links, held.toDF("from_id", "_a"), ["from_id"], "inner")
    ends = attach(ends, held.toDF("to_id", "_b"), ["to_id"], "inner")
    inside = ends.select(F.explode(F.array_intersect("_a", "_b")).alias("_slice"), *links.columns)
    return attach(inside, codes, ["_slice"], "inner").select("slice_id", *links.columns)


def induced_subgraph(links: DataFrame, core: DataFrame, one_hop: bool) -> tuple[DataFrame, DataFrame]:
    """(slice_id, segid) kept and the slice's links, from (slice_id, segid) cores.

    Strict keeps the core. One-hop keeps the ends of all links that touch the
    core, so a core segment without a link is dropped.
    """
    kept = materialise(touched_segments(links, core) if one_hop else core.select("slice_id", "segid"))
    return kept, links_inside(links, kept)


def top_counts(rows: DataFrame, value: str, name: str, top_k: int) -> DataFrame:
    """(slice_id, map of the top_k most frequent values), ties by value."""
    counts = rows.groupBy("slice_id", F.col(value).cast("string").alias("key")).agg(
        F.count("*").alias("n")
    )
    order = Window.partitionBy("slice_id").orderBy(F.desc("n"), "key")
    ranked = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    entries = F.array_sort(F.collect_list(F.struct("rank", "key", "n")))
    pairs = F.transform(entries, lambda e: F.struct(e["key"], e["n"]))
    return ranked.groupBy("slice_id").agg(F.map_from_entries(pairs).alias(name))


def value_counts(rows: DataFrame, value: str, name: str) -> DataFrame:
    """(slice_id, map of all values and their counts), for a column of few values."""
    counts = rows.groupBy("slice_id", F.col(value).cast("string").alias("key")).agg(
        F.count("*").alias("n")
    )
    order = F.array_sort(F.collect_list(F.struct(-F.col("n"), "key", "n")))
    pairs = F.transform(order, lambda e: F.struct(e["key"], e["n"]))
    return counts.groupBy("slice_id").agg(F.map_from_entries(pairs).alias(name))


def name_degrees(slice_links: DataFrame) -> DataFrame:
    """Degree per slice and segment over nodes that have a link."""
    ends = slice_links.select("slice_id", F.explode(F.array("from_seg", "to_seg")).alias("name"))
    return ends.groupBy("slice_id", "name").agg(F.count("*").alias("degree"))


def degree_profile(slice_links: DataFrame) -> DataFrame:
    return name_degrees(slice_links).groupBy("slice_id").agg(*_profile())


def _profile() -> list[Column]:
    return [
        F.max("degree").alias("max_degree"),
        (F.count_if(F.col("degree") > 2) / F.count("*")).alias("branching_frac_deg_gt_2"),
    ]


def slice_qc(slice_segments: DataFrame, slice_links: DataFrame, top_k: int = 10) -> DataFrame:
    """One quality row per slice: counts, top values, name degrees, orientations."""
    empty = F.create_map().cast("map<string,bigint>")
    out = slice_segments.groupBy("slice_id").agg(F.count("*").alias("n_segments"))
    out = out.join(slice_links.groupBy("slice_id").agg(F.count("*").alias("n_links")), "slice_id", "left")
    for part in (
        top_counts(slice_segments, "SR", "SR_counts_top", top_k),
        top_counts(slice_segments, "SN", "SN_counts_top", top_k),
        degree_profile(slice_links),
        value_counts(slice_links, "from_orient", "from_orient_counts"),
        value_counts(slice_links, "to_orient", "to_orient_counts"),
    ):
        out = out.join(part, "slice_id", "left")
    return out.select(
        "slice_id",
        "n_segments",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "SR_counts_top",
        "SN_counts_top",
        F.coalesce("max_degree", F.lit(0)).alias("max_degree"),
        F.coalesce("branching_frac_deg_gt_2", F.lit(0.0)).alias("branching_frac_deg_gt_2"),
        F.coalesce("from_orient_counts", empty).alias("from_orient_counts"),
        F.coalesce("to_orient_counts", empty).alias("to_orient_counts"),
    )


def verify_slices(
    slice_segments: DataFrame,
    slice_links: DataFrame,
    metadata: DataFrame,
    edge_pred: DataFrame | None = None,
) -> DataFrame:
    """One row per slice of `metadata` with its issues, `ok` and basic statistics.

    `metadata` has slice_id and, as far as known, the slice's fields; a missing
    column or null counts as a missing key.
    """
    # Slices go by numbers where their rows are shuffled; ends are counted by name before names
    # are held against the segments, once for the profile and for what is missing.
    codes = slice_codes(metadata)

    def coded(df: DataFrame) -> DataFrame:
        numbered = attach(df, codes, ["slice_id"], "inner").drop("slice_id")
        return numbered.withColumnRenamed("_slice", "slice_id")

    names = coded(slice_segments.select("slice_id", "name")).distinct().withColumn("_held", F.lit(True))
    segments = coded(slice_segments.select("slice_id", "SN")).groupBy("slice_id").agg(
        F.count("*").alias("n_seg"), F.countDistinct("SN").alias("n_sn")
    )
    ends = name_degrees(coded(slice_links.select("slice_id", "from_seg", "to_seg")))
    missing_ends = F.sum(F.when(F.col("_held").isNull(), F.col("degree"))).alias("n_dangling")
    profile = attach(ends, names, ["slice_id", "name"]).groupBy("slice_id").agg(missing_ends, *_profile())
    links = coded(slice_links.select("slice_id", "overlap")).groupBy("slice_id").agg(
        F.count("*").alias("n_lnk"), F.count_if(F.col("overlap") != "0M").alias("n_overlap")
    )
    out = metadata.drop("max_degree", "branching_frac_deg_gt_2")
    for part in (segments, links, profile):
        named = attach(part.withColumnRenamed("slice_id", "_slice"), codes, ["_slice"], "inner").drop("_slice")
        out = out.join(named, "slice_id", "left")
    if edge_pred is not None:
        classes = edge_pred.groupBy("slice_id").agg(
            F.count_if(F.col("label") == 1).alias("n_pos"),
            F.count_if(F.col("label") == 0).alias("n_neg"),
            F.count("*").alias("edge_pred_rows"),
        )
        out = out.join(classes, "slice_id", "left")

    def count(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    missing = [c for c in ("name", "SN", "SO", "LN", "SR") if c not in slice_segments.columns]
    checks = [F.lit(f"missing segment column {c}") for c in missing]
    checks.append(F.when(count("n_dangling") > 0, "link endpoints are not in the slice's segments"))
    if "overlap_all_0M" in metadata.columns:
        flagged = F.col("overlap_all_0M") & (count("n_overlap") > 0)
        checks.append(F.when(flagged, "metadata says overlap_all_0M but links differ"))
    if "closure" in metadata.columns:
        mixed_sn = (F.col("closure") == "strict") & (count("n_sn") != 1)
        checks.append(F.when(mixed_sn, F.concat(F.lit("strict slice with distinct SN: "), count("n_sn"))))
    for key in META_KEYS:
        absent = F.col(key).isNull() if key in metadata.columns else F.lit(True)
        checks.append(F.when(absent, f"metadata lacks {key}"))
    if edge_pred is not None:
        one_class = (count("n_pos") == 0) | (count("n_neg") == 0)
        checks.append(F.when(one_class, "edge_pred lacks one class"))
    issues = F.array_compact(F.array(*checks))
    shown = [c for c in ("target_sn", "closure") if c in metadata.columns]
    return out.select(
        "slice_id",
        *shown,
        (F.size(issues) == 0).alias("ok"),
        F.array_join(issues, " | ").alias("issues"),
        count("n_seg").alias("n_segments"),
        count("n_lnk").alias("n_links"),
        count("max_degree").alias("max_degree"),
        F.coalesce("branching_frac_deg_gt_2", F.lit(0.0)).alias("branching_frac_deg_gt_2"),
        (count("max_degree") > 10).alias("has_cycle_signal_proxy"),
        *([count("edge_pred_rows").alias("edge_pred_rows")] if edge_pred is not None else []),
    )


def _attempt_slices(
    index: DataFrame,
    links: DataFrame,
    metadata: DataFrame,
    attempts: DataFrame,
    closure: str,
    window_bp: int,
    rule: NegativeRule,
    seed: int,
) -> dict[str, DataFrame]:
    """Windows of one closure with their accepted links and balanced edges."""
    windows = choose_windows(index, attempts, window_bp, seed)
    named = windows.withColumn("closure", F.lit(closure)).withColumn(
        "slice_id", slice_id(F.col("target_sn"), F.col("start"), F.col("end"), F.lit(closure))
    )
    # Two attempts may settle on the same window; the first one keeps the name.
    first = materialise(
        named.groupBy("slice_id").agg(F.min_by(F.struct(*named.drop("slice_id").columns), "attempt").alias("w"))
        .select("slice_id", "w.*")
    )
    core = materialise(window_core(first, index))
    kept, slice_links = induced_subgraph(links, core, closure == "1hop")
    slice_links = materialise(slice_links)
    negatives = sample_negatives(slice_links, metadata, rule, seed)
    edges, filled = balanced_edges(slice_links, negatives, seed)
    rejected = first.join(filled, "slice_id", "left_anti").join(
        rejected_slices(slice_links, negatives), "slice_id", "left"
    )
    return {
        "windows": first.join(filled, "slice_id", "left_semi"),
        "rejected": rejected.withColumn("reason", F.coalesce("reason", F.lit("no links"))),
        "segments": kept,
        "links": slice_links,
        "edges": edges,
    }


def build_slices(
    index: DataFrame,
    links: DataFrame,
    targets: DataFrame,
    window_bp: int = 50_000,
    n_windows: int = 5,
    closures: tuple[str, ...] = ("strict", "1hop"),
    rule: NegativeRule = NegativeRule(),
    seed: int = 42,
    attempts_per_window: int = ATTEMPTS_PER_WINDOW,
) -> dict[str, DataFrame]:
    """Slice tables and manifest: `n_windows` accepted windows per contig and closure.

    Attempts are numbered per contig; a window without links or with too few
    negatives is rejected and a later attempt takes its place, up to
    `attempts_per_window` per wanted window. All contigs are tried together, one round
    per batch of attempts. `shortfall` (target_sn, closure, wanted, made) lists the
    contigs that could not be filled, and those without a segment; `rejected` lists
    the windows that have no links, or some links without a feasible negative.
    """
    metadata = materialise(oriented_metadata(index))
    # Contigs without a segment can never be filled, so they are not tried.
    asked = targets.select(F.col("SN").alias("target_sn")).distinct()
    targets = asked.join(index.select(F.col("SN").alias("target_sn")), "target_sn", "left_semi")
    parts: dict[str, list[DataFrame]] = {k: [] for k in ("windows", "segments", "links", "edges", "rejected")}
    for number, closure in enumerate(closures):
        open_targets = materialise(targets.withColumn("made", F.lit(0).cast("long")))
        begin, batch_size = 0, n_windows
        # Batches of 1, 2, 4 and 8 attempts per wanted window make up the limit.
        remaining = {"rows": 1}
        while begin < attempts_per_window * n_windows and remaining["rows"]:
            last = min(begin + batch_size, attempts_per_window * n_windows) - 1
            numbers = F.expr(f"sequence({begin}L, {last}L)")
            attempts = open_targets.select("target_sn", F.explode(numbers).alias("attempt"))
            batch = _attempt_slices(
                index, links, metadata, attempts, closure, window_bp, rule, seed + number
            )
            earlier = parts["windows"]
            fresh = batch["windows"]
            for done in earlier:
                fresh = fresh.join(done, "slice_id", "left_anti")
            order = Window.partitionBy("target_sn").orderBy("attempt")  # at most a batch of attempts
            fresh = materialise(
                fresh.join(open_targets, "target_sn")
                .withColumn("nth", F.row_number().over(order) + F.col("made"))
                .filter(F.col("nth") <= n_windows)
                .drop("made", "nth")
            )
            for key in ("segments", "links", "edges"):
                parts[key].append(attach(batch[key], fresh.select("slice_id"), ["slice_id"], "left_semi"))
            parts["windows"].append(fresh)
            parts["rejected"].append(batch["rejected"])
            new = fresh.groupBy("target_sn").agg(F.count("*").alias("new"))
            open_targets, remaining = materialise_counted(
                open_targets.join(new, "target_sn", "left")
                .select("target_sn", (F.col("made") + F.coalesce("new", F.lit(0))).alias("made"))
                .filter(F.col("made") < n_windows)
            )
            begin, batch_size = last + 1, batch_size * 2
    merged: dict[str, DataFrame] = {}
    for key, tables in parts.items():
        out = tables[0]
        for table in tables[1:]:
            out = out.unionByName(table)
        # Segments, links and edges stay the tables of their batches, less the slices not chosen.
        merged[key] = materialise(out) if key in ("windows", "rejected") else out
    columns = ["segid", "id", "name", "LN", "SN", "SO", "SR"]
    segments = attach(merged["segments"], index.select(*columns), ["segid"], "inner")
    manifest = slice_metadata(merged["windows"], segments, merged["links"], window_bp, rule)
    wanted = asked.withColumn("closure", F.explode(F.array(*map(F.lit, closures))))
    made = manifest.groupBy("target_sn", "closure").agg(F.count("*").alias("made"))
    shortfall = (
        wanted.join(made, ["target_sn", "closure"], "left")
        .select("target_sn", "closure", F.lit(n_windows).alias("wanted"), F.coalesce("made", F.lit(0)).alias("made"))
        .filter("made < wanted")
    )
    return {
        "shortfall": shortfall,
        "rejected": merged["rejected"].dropDuplicates(["slice_id"]),
        "slice_segments": segments,
        "slice_links": merged["links"],
        "slice_edge_pred": merged["edges"],
        "manifest": manifest,
    }


def slice_metadata(
    windows: DataFrame,
    slice_segments: DataFrame,
    slice_links: DataFrame,
    window_bp: int,
    rule: NegativeRule,
) -> DataFrame:
    """Window, sampler settings and quality fields, one row per slice."""
    settings = {
        "negative_sampler": rule.sampler,
        "negative_same_sn": rule.same_sn,
        "negative_coord_band": rule.coord_band,
        "negative_tol_bp": rule.tol_bp,
        "negative_tol_frac": rule.tol_frac,
        "negative_degree_matched": rule.degree_matched,
    }
    plain = slice_links.groupBy("slice_id").agg(
        F.bool_and(F.col("overlap") == "0M").alias("overlap_all_0M")
    )
    return (
        windows.join(plain, "slice_id", "left")
        .select(
            "slice_id",
            slice_name(F.col("target_sn"), F.col("start"), F.col("end"), F.col("closure")).alias("name"),
            F.lit("window").alias("type"),
            "target_sn",
            "start",
            "end",
            F.lit(window_bp).alias("window_bp"),
            "closure",
            F.col("n_core").alias("core_overlap_segments"),
            F.coalesce("overlap_all_0M", F.lit(True)).alias("overlap_all_0M"),
            *[F.lit(v).alias(k) for k, v in settings.items()],
        )
        .join(slice_qc(slice_segments, slice_links), "slice_id")
    )
