"""Near-duplicate classes through DartMinHash signatures and a banded join.

A document is a weighted set of 5-word shingles (ASCII white space separates words,
A-Z folded), the weight of a shingle being its number of occurrences. In the plane
of weight by rank, every shingle throws darts: a Poisson process of unit intensity,
drawn from hashes of the shingle, the unit strip of its weight and the number of
the dart, so that two documents share exactly the darts in the area they share.
A document looks at the darts in its region up to a rank theta = t / total weight,
about t darts whatever its length, deals them to k coordinates by hash, and keeps
the earliest of each. Two coordinates agree with the probability of the weighted
Jaccard similarity. Coordinates that got no dart make the document look further
(theta doubles), which never changes those already filled.

Bands of rows_per_band coordinates are joined. Buckets are not expanded into pairs:
in every round a few leaders of each unfinished bucket, those with the most company
first, are compared with the members that are not yet in their component, and then
leave the bucket. A bucket is finished when all its members are connected. So every
pair of a bucket is either compared or already connected through verified links.

A comparison first counts the bits in which two sketches differ, one bit for each of
1,024 further coordinates; only pairs within four standard deviations of the
threshold are written and compared by exact weighted Jaccard. Before that a parity
sketch refutes pairs without error: every element flips one of 1,024 bits, so two
parity sketches differ in at most as many bits as the texts have unshared elements. It
tells short texts apart almost exactly and says nothing on very long ones, which the
first sketch tells apart. A large group of copies that are mostly less similar to each
other than the threshold writes few pairs.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqbraid.llm.common import lookup, map_arrow, materialise, text_of
from seqbraid.llm.textnp import Slice, gram_hashes, mix, range_hashes, slices, words
from seqbraid.operators.graph import component_labels

SHINGLE = 5
SIMILARITY_PERCENT = 80
BANDS = 24
ROWS = 5
HOT_ROWS = 10_000
SKETCH_BITS = 1024
PARITY_BITS = 1024
_STEP = np.uint64(0x9E3779B97F4A7C15)


def salt(n: int) -> np.uint64:
    return np.uint64(n * 0xD1B54A32D192ED03 % (1 << 64))


def elements(part: Slice, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit element per unit of weight, and its text, sorted by text.

    The j-th occurrence of a shingle is an element of its own, so plain Jaccard over
    elements is weighted Jaccard over shingles. A text of fewer words than a shingle
    has all its words as one shingle; a text without words has no elements.
    """
    found = words(part)
    hashes = range_hashes(part, found.start, found.end, lower=True)
    grams, at = gram_hashes(hashes, found.row, shingle)
    row = found.row[at]
    for n in range(1, shingle):
        mine = found.counts[found.row] == n
        short, at = gram_hashes(hashes[mine], found.row[mine], n)
        grams, row = np.concatenate((grams, short)), np.concatenate((row, found.row[mine][at]))
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    heads = np.flatnonzero(fresh)
    copy = np.arange(len(grams)) - np.repeat(heads, np.diff(np.append(heads, len(grams))))
    return mix(grams + copy.astype(np.uint64) * _STEP), row


def _throw(
    element: np.ndarray, row: np.ndarray, theta: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All darts with rank up to theta of their text: flat coordinate, rank, dart id."""
    spots, ranks, ids = [], [], []
    rank = np.zeros(len(element))
    n = 0
    while len(element):
        n += 1
        dart = mix(element + salt(n))
        rank = rank - np.log1p(-(mix(dart ^ _STEP) >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        live = rank <= theta
        element, row, theta, rank, dart = (x[live] for x in (element, row, theta, rank, dart))
        spots.append(row * k + (dart % np.uint64(k)).astype(np.int64))
        ranks.append(rank)
        ids.append(dart)
    if not spots:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return np.concatenate(spots), np.concatenate(ranks), np.concatenate(ids)


def signatures(element: np.ndarray, row: np.ndarray, rows: int, k: int) -> np.ndarray:
    """rows x k dart ids: the earliest dart per coordinate. Texts without elements get zeros."""
    weight = np.bincount(row, minlength=rows)
    theta = k * (np.log(k) + 2) / np.maximum(weight, 1)
    best = np.full(rows * k, np.inf)
    sign = np.zeros(rows * k, np.uint64)
    todo = weight > 0
    while todo.any():
        mine = todo[row]
        spot, rank, dart = _throw(element[mine], row[mine], theta[row[mine]], k)
        np.minimum.at(best, spot, rank)
        won = rank == best[spot]
        sign[spot[won]] = dart[won]
        todo &= np.isinf(best.reshape(rows, k)).any(axis=1)
        theta = theta * 2
    return sign.reshape(rows, k)


def band_keys(sign: np.ndarray, bands: int, rows_per_band: int) -> np.ndarray:
    """A 64-bit key per text and band."""
    total = np.zeros((len(sign), bands), np.uint64)
    cut = sign[:, : bands * rows_per_band].reshape(len(sign), bands, rows_per_band)
    for j in range(rows_per_band):
        total += mix(cut[:, :, j] + salt(j + 1))
    return mix(total + np.arange(1, bands + 1, dtype=np.uint64) * _STEP)


def signed(docs: DataFrame, bands: int = BANDS, rows_per_band: int = ROWS) -> DataFrame:
    """doc_id, fp (128-bit hash of the folded text) and bands of every document."""
    k = bands * rows_per_band

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = []
            for part in slices(batch.column(1)):
                element, row = elements(part)
                found = band_keys(signatures(element, row, part.rows, k), bands, rows_per_band)
                has = np.bincount(row, minlength=part.rows) > 0
                keys += [x if ok else [] for x, ok in zip(found.view(np.int64), has, strict=True)]
            digest = [
                hashlib.md5(t.as_buffer() if t.is_valid else b"", usedforsecurity=False).digest()
                for t in batch.column(1)
            ]
            return pa.record_batch(
                [batch.column(0), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "fp", "bands"],
            )

        return each

    return map_arrow(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")),
        make,
        "doc_id long, fp binary, bands array<long>",
    )


def bit_sketches(element: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """rows x 16 words: one bit of the earliest dart of each of 1,024 coordinates."""
    sign = mix(signatures(element, row, rows, SKETCH_BITS) ^ _STEP) >> np.uint64(63)
    packed = np.packbits(sign.astype(np.uint8), axis=1, bitorder="little")
    return packed.view(np.int64).reshape(rows, SKETCH_BITS // 64)


def most_different_bits(percent: int) -> int:
    """Differing sketch bits of a pair at the similarity, plus four standard deviations."""
    p = (1 - percent / 100) / 2
    return int(SKETCH_BITS * p + 4 * (SKETCH_BITS * p * (1 - p)) ** 0.5)


def different_bits(a: str, b: str, bits: int = SKETCH_BITS) -> Column:
    words = [F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(bits // 64)]
    return reduce(Column.__add__, words)


def parity_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """rows x 16 words: whether an odd number of the distinct elements fall on each of 1,024 bits."""
    sizes = [len(x) for x in sets]
    spot = (np.concatenate(sets).view(np.uint32) % PARITY_BITS).astype(np.int64)
    spot += np.repeat(np.arange(len(sets)), sizes) * PARITY_BITS
    odd = (np.bincount(spot, minlength=len(sets) * PARITY_BITS) & 1).astype(np.uint8)
    packed = np.packbits(odd.reshape(len(sets), PARITY_BITS), axis=1, bitorder="little")
    return packed.view(np.int64).reshape(len(sets), PARITY_BITS // 64)


def may_be_similar(percent: int, x: str, y: str, n_x: str, n_y: str) -> Column:
    """False only for pairs below the similarity: unshared elements d, of n_x + n_y in all,
    of a pair at s satisfy d (1 + s) <= (n_x + n_y) (1 - s)."""
    unshared = F.greatest(different_bits(x, y, PARITY_BITS), F.abs(F.col(n_x) - F.col(n_y)))
    return unshared * (100 + percent) <= (F.col(n_x) + F.col(n_y)) * (100 - percent)


def element_sets(docs: DataFrame) -> DataFrame:
    """doc_id, elems (the distinct elements, cut to 32 bits) and both sketches of every document.

    Two texts of 20,000 words share 0.1 elements by chance, which moves no similarity by 1e-5.
    """

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets, sketches, parities = [], [], []
            for part in slices(batch.column(1)):
                element, row = elements(part)
                cuts = np.searchsorted(row, np.arange(1, part.rows))
                short = element.astype(np.uint32).view(np.int32)
                mine = [np.unique(x) for x in np.split(short, cuts)]
                sets += mine
                parities += list(parity_sketches(mine))
                sketches += list(bit_sketches(element, row, part.rows))
            kinds = pa.list_(pa.int32()), pa.list_(pa.int64())
            return pa.record_batch(
                [
                    batch.column(0),
                    pa.array(sets, kinds[0]),
                    pa.array(sketches, kinds[1]),
                    pa.array(parities, kinds[1]),
                ],
                ["doc_id", "elems", "sketch", "parity"],
            )

        return each

    return map_arrow(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")),
        make,
        "doc_id long, elems array<int>, sketch array<long>, parity array<long>",
    )


def verified(pairs: DataFrame, sets: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is at least `percent` / 100."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("elems").alias("_x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("elems").alias("_y"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("_x", "_y"))
    return both.filter(
        100 * shared >= percent * (F.size("_x") + F.size("_y") - shared)
    ).select("a", "b")


def classes(
    docs: DataFrame,
    bands: int = BANDS,
    rows_per_band: int = ROWS,
    percent: int = SIMILARITY_PERCENT,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class) and n_copies of every document.

    A class is a connected component of the links of similarity percent / 100 or more.
    Documents of the same text (null as empty) are one class without being compared, and
    only the smallest of them goes on; n_copies counts them. Texts without words other
    than equal ones link to nothing. With the default bands a pair at the threshold is
    missed with probability 1e-4, a pair at 0.85 with 1e-6. doc_id must be unique; an
    empty table gives an empty result, and further columns are not read.
    """
    rows = materialise(signed(docs, bands, rows_per_band))
    same = materialise(
        rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"))
    )
    members = lookup(rows.select("doc_id", "fp"), same, "fp", "n_copies", hot_rows)
    members = materialise(members.select("doc_id", "rep", "n_copies"))
    reps = same.select(F.col("rep").alias("doc_id"))
    banded = materialise(rows.join(reps, "doc_id").select("doc_id", "bands"))
    labels = _linked(docs, banded, percent, hot_rows, bands)
    labels = labels.select(F.col("doc_id").alias("rep"), "comp")
    # A representative has at most one label; many copies share one, so look it up by count.
    counts = same.select("rep", "n_copies").join(labels, "rep")
    found = lookup(members.drop("n_copies"), counts, "rep", "n_copies", hot_rows)
    plain = members.join(labels, "rep", "left_anti")
    return found.select("doc_id", F.col("comp").alias("class_id"), "n_copies").unionByName(
        plain.select("doc_id", F.col("rep").alias("class_id"), "n_copies")
    )


def _linked(
    docs: DataFrame, banded: DataFrame, percent: int, hot_rows: int, bands: int
) -> DataFrame:
    """doc_id, comp for the documents that share a bucket with another one."""
    entries = banded.select("doc_id", F.posexplode("bands").alias("band", "key"))
    buckets = materialise(
        entries.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    )
    shared = materialise(lookup(entries, buckets, "key", "_n", hot_rows))
    company = materialise(shared.groupBy("doc_id").agg(F.sum("_n").alias("company")))
    labels = company.select("doc_id", F.col("doc_id").alias("comp"))
    # The id lists grow with the documents, so they are merged at every size.
    wanted = company.select("doc_id").hint("merge")
    sets = materialise(element_sets(docs.join(wanted, "doc_id", "left_semi")))
    short = sets.select("doc_id", "sketch", "parity", F.size("elems").alias("n_elems"))
    known = company.join(short, "doc_id").join(banded, "doc_id")
    open_rows = materialise(shared.select("key", "band", "doc_id").join(known, "doc_id"))
    most = most_different_bits(percent)
    member = F.struct(
        F.col("doc_id").alias("lead"), "sketch", "parity", "n_elems", "comp", "bands"
    )
    # A pair is compared in the bucket of the first band it shares only.
    earlier = [
        (F.col("band") > i) & (F.get("bands", i) == F.get("_b", i)) for i in range(bands - 1)
    ]
    met_before = reduce(Column.__or__, earlier, F.lit(False))
    leaders_per_bucket = 1
    while True:
        # Buckets whose members are all in one component are finished.
        placed = materialise(open_rows.join(labels, "doc_id"))
        state = placed.groupBy("key").agg(
            F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count(F.lit(1)).alias("_n")
        )
        unfinished = materialise(state.filter("_lo < _hi").select("key", "_n"))
        if unfinished.isEmpty():
            return labels
        placed = materialise(lookup(placed, unfinished, "key", "_n", hot_rows))
        if leaders_per_bucket == 1:
            best = F.max_by(member, F.struct("company", -F.col("doc_id")))
            leaders = placed.groupBy("key").agg(best.alias("_l"), F.max("_n").alias("_n"))
        else:
            first = Window.partitionBy("key").orderBy(F.desc("company"), "doc_id")
            leaders = (
                placed.withColumn("_k", F.row_number().over(first))
                .filter(F.col("_k") <= leaders_per_bucket)
                .select("key", member.alias("_l"), "_n")
            )
        leaders = materialise(
            leaders.select(
                "key",
                "_l.lead",
                F.col("_l.sketch").alias("_s"),
                F.col("_l.parity").alias("_p"),
                F.col("_l.n_elems").alias("_e"),
                F.col("_l.comp").alias("_c"),
                F.col("_l.bands").alias("_b"),
                "_n",
            )
        )
        rows = placed.drop("_n")
        if leaders_per_bucket <= 8:
            met = lookup(rows, leaders, "key", "_n", hot_rows)
        else:
            met = rows.join(leaders, "key")
        pairs = (
            met.filter((F.col("comp") != F.col("_c")) & (different_bits("sketch", "_s") <= most))
            .filter(may_be_similar(percent, "parity", "_p", "n_elems", "_e"))
            .filter(~met_before)
            .select(F.least("doc_id", "lead").alias("a"), F.greatest("doc_id", "lead").alias("b"))
            .distinct()
        )
        links = materialise(verified(materialise(pairs), sets, percent))
        if not links.isEmpty():
            labels = materialise(_merged(labels, links))
        gone = leaders.select("key", F.col("lead").alias("doc_id"))
        open_rows = materialise(
            rows.drop("comp").join(gone, ["key", "doc_id"], "left_anti")
        )
        leaders_per_bucket *= 8


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after joining the components of the linked documents."""
    a = labels.select(F.col("doc_id").alias("a"), F.col("comp").alias("u"))
    b = labels.select(F.col("doc_id").alias("b"), F.col("comp").alias("v"))
    edges = materialise(links.join(a, "a").join(b, "b").select("u", "v").distinct())
    roots = component_labels(edges).select(F.col("oid").alias("comp"), "root")
    return labels.join(roots, "comp", "left").select(
        "doc_id", F.coalesce("root", "comp").alias("comp")
    )


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, that with the smallest id, with the columns of `docs`.

    Of rows with one id one stays. A row without an id takes part under a number made from
    its text, above all usual ids, so it stays only if its class has no row with an id, and
    once. A null text is an empty one. An empty table gives an empty one; doc_id is integral.
    """
    unnamed = F.lit(1 << 62) + F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1))
    named = docs.withColumn("_keep_first_id", F.coalesce(F.col("doc_id").cast("long"), unnamed))
    found = classes(named.select(F.col("_keep_first_id").alias("doc_id"), "text"), **options)
    kept = materialise(found.filter("doc_id = class_id").select(F.col("doc_id").alias("_keep_first_id")).distinct())
    # Merged by id, so rows with one id come one after another.
    order = Window.partitionBy("_keep_first_id").orderBy("_keep_first_id")
    left = named.join(kept.hint("merge"), "_keep_first_id", "left_semi").withColumn("_keep_first_n", F.row_number().over(order))
    return left.filter("_keep_first_n = 1").select(*docs.columns)
