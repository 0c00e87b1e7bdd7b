"""Reproducible sampling: matched negative pairs, edge dropping, down-sampling.

Random draws are hashes of (seed, slice, anchor, try), so the result depends on
data and seed alone. Every positive link is one anchor. It tries 0, 1, 2, ...
and takes the first pair that passes; only unfilled anchors go into the next
round. A random draw's rank meets its node by an equi-join on (slice, rank): ranks are
spread evenly, so even one giant slice is spread over all tasks. Matched draws, of which
there are hundreds per link, are looked up inside tasks (`draws.py`). Anchors that
no try filled are settled by order statistics of their pool, so an anchor stays
unfilled only if no pair of its slice passes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqbraid.functions.hashing import draw, keep_fraction
from seqbraid.operators.draws import PART_LINKS, matched_pairs
from seqbraid.operators.index import link_ends, oriented_degree
from seqbraid.operators.ordering import running_sums, with_position
from seqbraid.operators.skew import attach
from seqbraid.session import materialise, materialise_counted

SAMPLERS = ("random", "hard_coord_degree", "distance_matched")
# Tries per anchor before its pool is searched exactly.
TRY_LIMIT = {"random": 80, "hard_coord_degree": 200, "distance_matched": 400}
# Tries of the first round. A random pair nearly always passes, a matched one seldom does.
FIRST_ROUND = {"random": 1, "hard_coord_degree": 16, "distance_matched": 16}


@dataclass(frozen=True)
class NegativeRule:
    sampler: str = "random"
    same_sn: bool = True
    coord_band: int = 5_000
    tol_bp: int = 1_000
    tol_frac: float = 0.10
    degree_matched: bool = False

    def __post_init__(self) -> None:
        if self.sampler not in SAMPLERS:
            raise ValueError(f"unknown negative sampler {self.sampler!r}; choose from {SAMPLERS}")

    @property
    def anchored(self) -> bool:
        return self.sampler != "random"

    @property
    def pool(self) -> list[str]:
        """Columns that delimit the nodes a draw chooses from."""
        return ["slice_id", "SN"] if self.anchored and self.same_sn else ["slice_id"]

    def tolerance(self) -> Column:
        """Largest accepted difference between an anchor's distance and a pair's."""
        if self.sampler == "hard_coord_degree":
            return F.lit(self.coord_band)
        share = F.floor(F.lit(self.tol_frac) * F.col("d_pos"))
        return F.greatest(F.lit(int(self.tol_bp)), share)


def _slice_nodes(slice_links: DataFrame, metadata: DataFrame) -> DataFrame:
    """(slice_id, oid, SN, SO, degree) for every node of every slice."""
    degrees = oriented_degree(slice_links, ("slice_id",))
    return attach(degrees, metadata.select("oid", "SN", "SO"), ["oid"], "inner")


def slice_codes(rows: DataFrame) -> DataFrame:
    """(slice_id, _slice): a short number for every slice, as ids are long texts to shuffle and sort."""
    ids = rows.select("slice_id").distinct()
    coded = with_position(ids, ["slice_id"], name="_slice")
    return materialise(coded.select("slice_id", F.col("_slice").cast("int").alias("_slice")))


def _without(rows: DataFrame, unknown: DataFrame, ends: tuple[str, ...]) -> DataFrame:
    """Rows of which no end is null or one of the oids in `unknown`."""
    for end in ends:
        side = unknown.withColumnRenamed("oid", end)
        rows = attach(rows.filter(F.col(end).isNotNull()), side, [end], "left_anti")
    return rows


def _anchors(slice_links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Positives with their distance, contig and degrees."""
    out = slice_links.select("slice_id", "link_id", F.col("u").alias("u_pos"), F.col("v").alias("v_pos"))
    for end in ("u", "v"):
        side = nodes.select(
            "slice_id",
            F.col("oid").alias(f"{end}_pos"),
            F.col("SO").alias(f"so_{end}_pos"),
            F.col("degree").alias(f"deg_{end}_pos"),
            *([F.col("SN")] if end == "u" else []),
        )
        out = attach(out, side, ["slice_id", f"{end}_pos"], "inner")
    return out.select(
        "slice_id",
        "link_id",
        "SN",
        F.abs(F.col("so_u_pos") - F.col("so_v_pos")).alias("d_pos"),
        "deg_u_pos",
        "deg_v_pos",
    )


def _random_pairs(
    waiting: DataFrame, ranked: DataFrame, codes: DataFrame, seed: int, tries: range
) -> DataFrame:
    """(_slice, link_id, try, u, v) of all given tries, also those that draw one node twice.

    `waiting` has _slice and link_id, `codes` also the size `n` of every slice.
    """
    turns = F.sequence(F.lit(tries.start), F.lit(tries.stop - 1))
    if len(tries) > 1:
        # One anchor becomes many draws, so anchors are spread before, not after.
        waiting = waiting.repartition("_slice", "link_id")
    draws = attach(waiting, codes, ["_slice"], "inner").select("*", F.explode(turns).alias("try"))
    ranks = {
        f"rank_{end}": draw(seed, "slice_id", "link_id", F.col("try") * 2 + turn) % F.col("n")
        for end, turn in (("u", 0), ("v", 1))
    }
    draws = draws.select("_slice", "link_id", "try", *[rank.alias(name) for name, rank in ranks.items()])
    for end in ("u", "v"):
        side = ranked.select("_slice", F.col("rank").alias(f"rank_{end}"), F.col("oid").alias(end))
        draws = draws.join(side, ["_slice", f"rank_{end}"])
    return draws.select("_slice", "link_id", "try", "u", "v")


def _random_round(
    waiting: DataFrame, ranked: DataFrame, codes: DataFrame, positives: DataFrame, seed: int, tries: range
) -> tuple[DataFrame, DataFrame, dict]:
    """Hits of a round, the anchors that still wait, and their number.

    Of a round of one try, which nearly every pair passes, only the few that do not are looked for.
    """
    met = _random_pairs(waiting, ranked, codes, seed, tries)
    if len(tries) == 1:
        met = materialise(met)
        same = met.filter("u = v").select("_slice", "link_id")
        taken = met.filter("u <> v").join(positives, ["_slice", "u", "v"], "left_semi")
        failed, left = materialise_counted(same.unionByName(taken.select("_slice", "link_id")))
        return met.join(failed, ["_slice", "link_id"], "left_anti"), failed, left
    passed = met.filter("u <> v").join(positives, ["_slice", "u", "v"], "left_anti")
    hits = materialise(_first_hits(passed, "_slice"))
    failed, left = materialise_counted(waiting.join(hits, ["_slice", "link_id"], "left_anti"))
    return hits, failed, left


def _first_hits(passed: DataFrame, slice_key: str = "slice_id") -> DataFrame:
    """The first try of every anchor among those that pass."""
    best = passed.groupBy(slice_key, "link_id").agg(F.min_by(F.struct("u", "v"), "try").alias("p"))
    return best.select(slice_key, "link_id", "p.u", "p.v")


def _rounds(limit: int, first_step: int) -> list[range]:
    """Tries by round; each round is four times as long as the one before, for fewer anchors."""
    out, first, step = [], 0, first_step
    while first < limit:
        out.append(range(first, min(first + step, limit)))
        first, step = out[-1].stop, step * 4
    return out


def sample_negatives(
    slice_links: DataFrame,
    metadata: DataFrame,
    rule: NegativeRule = NegativeRule(),
    seed: int = 42,
    first_round: int | None = None,
) -> DataFrame:
    """(slice_id, link_id, u, v): one accepted pair for every anchor that has any.

    Anchors left over by the tries are settled by `_settle`. `slice_links` has slice_id, link_id, u, v; `metadata` is keyed by oid.
    How many tries a round takes changes its cost only, never the pairs.
    """
    rounds = _rounds(TRY_LIMIT[rule.sampler], first_round or FIRST_ROUND[rule.sampler])
    sample = _sample_matched if rule.anchored else _sample_random
    found = sample(slice_links, metadata, rule, seed, rounds)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _sample_random(
    slice_links: DataFrame, metadata: DataFrame, rule: NegativeRule, seed: int, rounds: list[range]
) -> list[DataFrame]:
    """Pairs of any two nodes of a slice: an anchor needs its id only, and no feature of a node."""
    links = slice_links.select("slice_id", "link_id", "u", "v")
    codes = slice_codes(links)
    coded = attach(links, codes, ["slice_id"], "inner").select("_slice", "link_id", "u", "v")
    nodes = link_ends(coded, ("_slice",)).distinct()
    # An end without metadata is no node, and its link no anchor.
    unknown = link_ends(links).distinct().join(metadata.select("oid"), "oid", "left_anti")
    unknown, strange = materialise_counted(unknown)
    if strange["rows"]:
        nodes, coded = _without(nodes, unknown, ("oid",)), _without(coded, unknown, ("u", "v"))
    ranked = materialise(with_position(nodes, ["oid"], ["_slice"], "rank"))
    sizes = ranked.groupBy("_slice").agg(F.count("*").alias("n"))
    codes = materialise(codes.join(sizes, "_slice"))
    waiting, taken = coded.select("_slice", "link_id"), coded.select("_slice", "u", "v")
    found: list[DataFrame] = []
    for tries in rounds:
        hits, waiting, left = _random_round(waiting, ranked, codes, taken, seed, tries)
        named = attach(hits, codes, ["_slice"], "inner")
        found.append(named.select("slice_id", "link_id", "u", "v"))
        if not left["rows"]:
            return found
    everyone = materialise(_slice_nodes(links, metadata))
    named = attach(waiting, codes, ["_slice"], "inner").select("slice_id", "link_id")
    positives = links.select("slice_id", "u", "v").distinct()
    return found + _settle(named, everyone, positives, rule, seed)


def _sample_matched(
    slice_links: DataFrame, metadata: DataFrame, rule: NegativeRule, seed: int, rounds: list[range]
) -> list[DataFrame]:
    nodes = materialise(_slice_nodes(slice_links, metadata))
    ranked = materialise(with_position(nodes, ["oid"], rule.pool, "rank"))
    sizes = ranked.groupBy(*rule.pool).agg(F.count("*").alias("n"))
    anchors = attach(_anchors(slice_links, nodes), sizes, rule.pool, "inner")
    waiting = materialise(anchors)
    asked = waiting.groupBy(*rule.pool).agg(F.count("*").alias("_links"), F.first("n").alias("_n"))
    parts = F.ceil(F.col("_links") / F.greatest(F.lit(PART_LINKS), F.col("_n") / 4)).cast("long")
    parts = materialise(asked.select(*rule.pool, parts.alias("parts")))
    waiting = attach(waiting, parts, rule.pool, "inner")
    positives = slice_links.select("slice_id", "u", "v").distinct()
    found: list[DataFrame] = []
    for tries in rounds:
        met = matched_pairs(waiting, ranked, rule.pool, rule.tolerance(), rule.degree_matched, seed, tries)
        passed = met.join(positives, ["slice_id", "u", "v"], "left_anti")
        hits = materialise(_first_hits(passed))
        found.append(hits)
        waiting, left = materialise_counted(
            waiting.join(hits, ["slice_id", "link_id"], "left_anti")
        )
        if not left["rows"]:
            return found
    return found + _settle(waiting, nodes, positives, rule, seed)


# Distances above any real one, for rules without a distance.
_EVERY_DISTANCE = 1 << 60
# Rows of (anchor, first node) that one round of settlement looks at, for every core.
SETTLE_ROWS = 100_000


def _ranks_below(rows: DataFrame, asked: DataFrame, group: list[str], marks: list[str]) -> DataFrame:
    """`asked` with, for each column of `marks`, the number of `rows` in its group at or below it.

    `rows` has the group, `at` and a unique `tie`. Both are sorted together once, so neither a large group
    nor many questions to one group meet in a task, and no pair of the two is made.
    """
    key = [c for c in asked.columns if c not in marks]
    cut = F.explode(F.array(*[F.struct(F.lit(m).alias("mark"), F.col(m).alias("at")) for m in marks]))
    points = asked.select(*key, cut.alias("_p")).select(*key, "_p.mark", "_p.at")
    extra = [c for c in points.columns if c not in (*group, "at")]
    blank = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in extra]
    both = rows.select(*group, "at", "tie", F.lit(1).alias("counts"), *blank).unionByName(
        points.withColumns({"counts": F.lit(0), "tie": F.lit(None).cast("long")})
    )
    # At one place the rows come before the questions.
    order = ["at", F.desc("counts"), "tie", *extra]
    counted = running_sums(both, order, group, {"_below": F.col("counts")}).filter("counts = 0")
    return counted.groupBy(*key).agg(
        *[F.max(F.when(F.col("mark") == m, F.col("_below"))).alias(m) for m in marks]
    )


def _partner_counts(
    tries: DataFrame, nodes: DataFrame, positives: DataFrame, pool: list[str]
) -> DataFrame:
    """`tries` (an anchor next to a first node) with the number `feasible` of partners.

    Partners stand at a distance from `nearest` to `farthest` on either side of the first
    node: two stretches of the pool's order, from ranks `a0` and `b0` to `a1` and `b1`.
    Their number is a difference of ranks, less the node itself and its positives there.
    """
    one = F.col("nearest") <= 0
    so, far, near = F.col("so_u"), F.col("farthest"), F.col("nearest")
    marks = {
        "a0": so - far - 1,
        "a1": F.when(one, so + far).otherwise(so - near),
        "b0": F.when(one, so + far).otherwise(so + near - 1),
        "b1": so + far,
    }
    row = ["slice_id", "link_id", "side", "step"]
    asked = tries.select(*row, *pool[1:], "kind_v", "u", *[m.alias(n) for n, m in marks.items()])
    group = [*pool, "kind_v"]
    place = [F.col("so_v").alias("at"), F.col("v").alias("tie")]
    inside = F.col("a1") - F.col("a0") + F.col("b1") - F.col("b0")
    own = F.when(one & (F.col("kind") == F.col("kind_v")), 1).otherwise(0)
    ranked = _ranks_below(nodes.select(*group, *place), asked, group, list(marks))
    # Most first nodes have no partner at all; only the others are held against positives.
    some = materialise(
        tries.join(ranked.select(*row, *marks), row)
        .withColumn("feasible", inside - own)
        .filter("feasible > 0")
    )
    asked = asked.join(some.select(*row), row, "left_semi")
    taken = _ranks_below(positives.select(*group, "u", *place), asked, [*group, "u"], list(marks))
    return some.join(taken.select(*row, inside.alias("_taken")), row).withColumn(
        "feasible", F.col("feasible") - F.col("_taken")
    )


def _kth_partner(
    chosen: DataFrame, nodes: DataFrame, positives: DataFrame, pool: list[str]
) -> DataFrame:
    """(slice_id, link_id, u, v): the partner whose place among the feasible ones is drawn (`pick`).

    Places are counted along SO and oid. Each place that is not feasible (the node itself, a
    positive) and comes before the drawn one moves it on by one.
    """
    group = [*pool, "kind_v"]
    row = ["slice_id", "link_id"]
    wide = chosen.withColumn("k", F.col("pick") % F.col("feasible"))
    first = F.col("a1") - F.col("a0")
    place = F.when(F.col("rank_v") < F.col("a1"), F.col("rank_v") - F.col("a0")).otherwise(
        first + F.col("rank_v") - F.col("b0")
    )
    between = ((F.col("rank_v") >= F.col("a0")) & (F.col("rank_v") < F.col("a1"))) | (
        (F.col("rank_v") >= F.col("b0")) & (F.col("rank_v") < F.col("b1"))
    )
    ends = ["a0", "a1", "b0", "b1", "k"]
    own = nodes.select(*group, F.col("v").alias("u"), "rank_v")
    used = positives.select(*group, "u", "rank_v").unionByName(own)
    barred = wide.select(*row, *group[1:], "u", *ends).join(used, [*group, "u"]).filter(between)
    barred = with_position(barred.select(*row, "k", place.alias("place")), ["place"], row, "i")
    shift = barred.filter(F.col("place") - F.col("i") <= F.col("k")).groupBy(*row).agg(
        F.count("*").alias("shift")
    )
    at = F.col("k") + F.coalesce("shift", F.lit(0))
    rank = F.when(at < first, F.col("a0") + at).otherwise(F.col("b0") + at - first)
    placed = wide.join(shift, row, "left").withColumn("rank_v", rank)
    return placed.join(nodes.select(*group, "rank_v", "v"), [*group, "rank_v"]).select(*row, "u", "v")


def _settle(
    waiting: DataFrame, nodes: DataFrame, positives: DataFrame, rule: NegativeRule, seed: int
) -> list[DataFrame]:
    """Hits of the anchors that have a feasible pair, by order statistics.

    Every anchor walks the possible first nodes of its pool from a hashed start. How many
    partners a first node has follows from ranks along SO, without making a pair; at the
    first node that has any, the drawn one of its partners is looked up by its rank. An
    anchor without a feasible pair costs one row for every node of its pool. Slices go by
    their numbers, as everything here is sorted or shuffled by them.
    """
    codes = slice_codes(nodes)
    drawn = {name: draw(seed, "slice_id", "link_id", F.lit(key)) for name, key in (("start", "settle"), ("pick", "partner"))}

    def coded(df: DataFrame) -> DataFrame:
        numbered = attach(df, codes, ["slice_id"], "inner").drop("slice_id")
        return numbered.withColumnRenamed("_slice", "slice_id")

    waiting, nodes, positives = coded(waiting.withColumns(drawn)), coded(nodes), coded(positives)
    kind = F.col("degree") if rule.degree_matched else F.lit(0).cast("long")
    pool, group = rule.pool, [*rule.pool, "kind"]
    walked = materialise(with_position(nodes.withColumn("kind", kind), ["oid"], group, "rank"))
    sizes = walked.groupBy(*group).agg(F.count("*").alias("n_first"))
    ends = [F.struct(F.lit(0).alias("side"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))]
    if rule.degree_matched:
        degrees = [("deg_u_pos", "deg_v_pos"), ("deg_v_pos", "deg_u_pos")]
        ends = [F.struct(F.lit(i).alias("side"), F.col(a).alias("a"), F.col(b).alias("b")) for i, (a, b) in enumerate(degrees)]
    sided = waiting.select("*", F.explode(F.array(*ends)).alias("e"))
    if rule.degree_matched:
        sided = sided.filter("e.side = 0 or e.a <> e.b")
    tolerance = rule.tolerance().cast("long") if rule.anchored else F.lit(_EVERY_DISTANCE)
    sided = sided.select(
        "slice_id",
        "link_id",
        *pool[1:],
        "start",
        "pick",
        "e.side",
        F.col("e.a").alias("kind"),
        F.col("e.b").alias("kind_v"),
        ((F.col("d_pos") if rule.anchored else F.lit(0)) - tolerance).alias("nearest"),
        ((F.col("d_pos") if rule.anchored else F.lit(0)) + tolerance).alias("farthest"),
    )
    sided, left = materialise_counted(attach(sided, sizes, group, "inner"), top=F.max("n_first"))
    if not left["rows"]:
        return []
    # Only pools that an anchor still waits in are sorted.
    asked_of = sided.select(*pool).distinct()
    second = attach(walked, asked_of, pool, "left_semi").select(
        *pool, F.col("kind").alias("kind_v"), F.col("oid").alias("v"), F.col("SO").alias("so_v")
    )
    second = materialise(with_position(second, ["so_v", "v"], [*pool, "kind_v"], "rank_v"))
    ends_v = second.select("slice_id", "v", *pool[1:], "kind_v", "so_v", "rank_v")
    barred = materialise(attach(positives.filter("u <> v"), ends_v, ["slice_id", "v"], "inner"))
    firsts = walked.select(*group, F.col("rank").alias("at"), F.col("oid").alias("u"), F.col("SO").alias("so_u"))
    spark = waiting.sparkSession
    budget = SETTLE_ROWS * spark.sparkContext.defaultParallelism
    found: list[DataFrame] = []
    first = step = 0
    while left["rows"] and first < left["top"]:
        # One first node while many anchors wait, as half of them have a partner; then twice as
        # many in every round, all of a pool for the last anchors.
        step = max(2 * step, budget // left["rows"], 1)
        steps = F.sequence(F.lit(first).cast("long"), F.least(F.lit(first + step), F.col("n_first")) - 1)
        tries = (
            sided.filter(F.col("n_first") > first)
            .repartition("slice_id", "link_id", "side")
            .select("*", F.explode(steps).alias("step"))
            .withColumn("at", (F.col("start") % F.col("n_first") + F.col("step")) % F.col("n_first"))
            .join(firsts, [*group, "at"])
        )
        counted = _partner_counts(materialise(tries), second, barred, pool).filter("feasible > 0")
        names = [c for c in counted.columns if c not in ("slice_id", "link_id")]
        chosen = materialise(
            counted.groupBy("slice_id", "link_id")
            .agg(F.min_by(F.struct(*names), F.struct("step", "side")).alias("p"))
            .select("slice_id", "link_id", *[f"p.{c}" for c in names])
        )
        partners = materialise(_kth_partner(chosen, second, barred, pool)).withColumnRenamed("slice_id", "_slice")
        found.append(attach(partners, codes, ["_slice"], "inner").select("slice_id", "link_id", "u", "v"))
        sided, left = materialise_counted(
            sided.join(chosen, ["slice_id", "link_id"], "left_anti"), top=F.max("n_first")
        )
        first += step
    return found


def rejected_slices(slice_links: DataFrame, negatives: DataFrame) -> DataFrame:
    """(slice_id, n_pos, n_neg, reason) of the slices that `balanced_edges` leaves out."""
    need = slice_links.groupBy("slice_id").agg(F.count("*").alias("n_pos"))
    have = negatives.groupBy("slice_id").agg(F.count("*").alias("n_neg"))
    short = need.join(have, "slice_id", "left").withColumn("n_neg", F.coalesce("n_neg", F.lit(0)))
    reason = F.concat((F.col("n_pos") - F.col("n_neg")).cast("string"), F.lit(" links have no feasible pair"))
    return short.filter("n_neg < n_pos").withColumn("reason", reason)


def balanced_edges(
    slice_links: DataFrame, negatives: DataFrame, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(edge table, filled slices): one negative per positive, short slices dropped.

    `rejected_slices` lists the dropped ones with the reason.

    The edge table has slice_id, u_oid, v_oid, label and `shuffle_key`, the
    reproducible row order within a slice.
    """
    need = slice_links.groupBy("slice_id").agg(F.count("*").alias("n_pos"))
    have = negatives.groupBy("slice_id").agg(F.count("*").alias("n_neg"))
    # Written, so that the planner knows how few they are and leaves the edges where they lie.
    filled = materialise(need.join(have, "slice_id").filter("n_neg >= n_pos").select("slice_id"))

    def labelled(df: DataFrame, label: int) -> DataFrame:
        return df.select(
            "slice_id",
            F.col("u").alias("u_oid"),
            F.col("v").alias("v_oid"),
            F.lit(label).alias("label"),
            draw(seed, "link_id", F.lit(label)).alias("shuffle_key"),
        )

    both = labelled(slice_links, 1).unionByName(labelled(negatives, 0))
    return attach(both, filled, ["slice_id"], "left_semi"), filled


def drop_edges(edges: DataFrame, key: str, rate: float, seed: int = 42) -> DataFrame:
    """Keep every edge with probability 1 - rate, decided by its key."""
    if rate <= 0:
        return edges
    return edges.filter(keep_fraction(draw(seed, key), 1.0 - rate))


def downsample(
    rows: DataFrame, condition: Column, fraction: float, key: str, seed: int = 42
) -> DataFrame:
    """Keep exactly floor(n * fraction) of the rows that meet `condition`, and all others.

    The kept ones are the first in hash order, ranked over ranges rather than
    in one window, as the class may hold most of the table.
    """
    if fraction >= 1:
        return rows
    marked = rows.withColumn("_class", F.coalesce(condition, F.lit(False)))
    chosen = marked.filter("_class").select(F.col(key), draw(seed, key).alias("_h"))
    ranked = materialise(with_position(chosen, ["_h", key], name="_rank"))
    quota = ranked.agg(F.floor(F.count("*") * F.lit(fraction)).alias("_quota"))
    kept = ranked.join(F.broadcast(quota), how="cross").filter("_rank < _quota").select(key)
    kept_class = marked.filter("_class").join(kept, key, "left_semi")
    return kept_class.unionByName(marked.filter("not _class")).drop("_class")
