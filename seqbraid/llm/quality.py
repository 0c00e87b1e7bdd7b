"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

The byte n-grams of every text are hashed into a fixed number of buckets. Two
multinomials over the buckets, one of trusted texts and one of the raw corpus, give
each bucket a log ratio; the score of a document is the mean over its n-grams, so
it does not depend on the length. Documents at or above a fixed threshold are kept.

Raw counts cover all documents. The trusted multinomial is fitted on at most
`target_docs` documents with quality label 1, chosen by the hash of their id, so
that the ids can be broadcast whatever the size of the label table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqbraid.llm.common import begin, drop_unused, give_back, map_arrow, materialise, ready, text_of
from seqbraid.llm.textnp import Slice, gram_hashes, mix, range_hashes, slices, words

BUCKETS = 1 << 16
GRAM = 3
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
THRESHOLD = -0.5
TARGET_DOCS = 50_000
# The trusted counts get this share of extra mass, spread as the raw corpus is.
PRIOR = 0.03

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def rule_counts(part: Slice) -> dict[str, np.ndarray]:
    """The base counts of every text of a slice."""
    found = words(part)
    rows = part.rows
    is_char = (part.data & 0xC0) != 0x80
    is_space = np.isin(part.data, [0x20, 9, 10, 11, 12, 13])

    # Lines: they start at a text's start and after each newline.
    breaks = np.flatnonzero(part.data == 10)
    line_start = np.concatenate((part.offsets[:-1], breaks + 1))
    line_row = np.concatenate(
        (np.arange(rows), np.searchsorted(part.offsets[1:], breaks, "right"))
    )
    order = np.lexsort((line_start, line_row))
    line_start, line_row = line_start[order], line_row[order]
    line_end = np.append(line_start[1:] - 1, len(part.data))
    line_end = np.where(np.append(line_row[1:] != line_row[:-1], True), part.offsets[line_row + 1], line_end)
    with_word = np.searchsorted(found.start, line_end) > np.searchsorted(found.start, line_start)
    line_start, line_end, line_row = line_start[with_word], line_end[with_word], line_row[with_word]
    line_hash = range_hashes(part, line_start, line_end)
    order = np.lexsort((line_hash, line_row))
    same = (line_hash[order][1:] == line_hash[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    dup_lines = np.bincount(line_row[order][1:][same], minlength=rows)

    # Words covered by windows that occur twice or more.
    word_hash = range_hashes(part, found.start, found.end)
    grams, at = gram_hashes(word_hash, found.row, WINDOW)
    keyed = mix(grams + found.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keyed)
    equal = keyed[order][1:] == keyed[order][:-1]
    twice = np.zeros(len(keyed), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    edge = np.zeros(len(word_hash) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return {
        "n_words": found.counts,
        "word_chars": part.totals(is_char & ~is_space),
        "n_symbols": part.totals(_IS_SYMBOL[part.data]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": np.bincount(found.row[covered], minlength=rows),
    }


def bucket_ids(part: Slice, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the n-gram at every byte, and whether the n-gram ends inside its text."""
    n = len(part.data)
    wide = np.zeros(n + GRAM - 1, np.uint64)
    wide[:n] = part.data
    value = np.zeros(n, np.uint64)
    for j in range(GRAM):
        value = (value << np.uint64(8)) | wide[j : j + n]
    valid = np.ones(n, bool)
    for j in range(1, GRAM):
        at = part.offsets[1:] - j
        valid[at[at >= part.offsets[:-1]]] = False
    return (mix(value) % np.uint64(buckets)).astype(np.int64), valid


def gram_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n_raw, n_target over all documents; `docs` has text and is_target."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        drop_unused()
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            chosen = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for part in slices(batch.column(0)):
                bucket, valid = bucket_ids(part, buckets)
                raw += np.bincount(bucket[valid], minlength=buckets)
                mine = chosen[part.first : part.first + part.rows]
                if mine.any():
                    own = np.repeat(mine, np.diff(part.offsets)) & valid
                    target += np.bincount(bucket[own], minlength=buckets)
        batch = chosen = part = bucket = valid = mine = own = None
        give_back()
        at = np.flatnonzero(raw)
        if len(at):
            yield pa.record_batch([at, raw[at], target[at]], ["bucket", "n_raw", "n_target"])

    counted = docs.select(text_of().alias("text"), "is_target").mapInArrow(
        run, "bucket long, n_raw long, n_target long"
    )
    return counted.groupBy("bucket").agg(
        F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target")
    )


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log ratio of every bucket; all zero where there is no trusted text."""
    if not target.sum() or not raw.sum():
        return np.zeros(len(raw))
    p_raw = (raw + 0.5) / (raw.sum() + 0.5 * len(raw))
    p_target = (target + PRIOR * target.sum() * p_raw) / (target.sum() * (1 + PRIOR))
    return np.log(p_target / p_raw)


def trusted_ids(labels: DataFrame, target_docs: int = TARGET_DOCS) -> DataFrame:
    """At most `target_docs` ids with quality 1, in the order of the hash of the id."""
    ids = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_docs)


def fit_ratios(
    docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, target_docs: int = TARGET_DOCS
) -> np.ndarray:
    """The log ratio table: one pass over all documents; `buckets` rows reach the driver."""
    trusted = materialise(trusted_ids(labels, target_docs)).withColumn("_t", F.lit(True))
    marked = docs.join(F.broadcast(trusted), "doc_id", "left").select(
        "text", F.coalesce("_t", F.lit(False)).alias("is_target")
    )
    counts = gram_counts(marked, buckets).toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[counts["bucket"]] = counts["n_raw"]
    target[counts["bucket"]] = counts["n_target"]
    return log_ratios(raw, target)


_SCORED = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, llr double, kept boolean"
)


def score_slice(part: Slice, ratios: np.ndarray, threshold: float) -> list[np.ndarray]:
    counts = rule_counts(part)
    bucket, valid = bucket_ids(part, len(ratios))
    total = np.concatenate(([0.0], np.cumsum(np.where(valid, ratios[bucket], 0.0))))
    sums = total[part.offsets[1:]] - total[part.offsets[:-1]]
    llr = sums / np.maximum(part.totals(valid), 1)
    failed = (counts["n_words"] < MIN_WORDS) | (
        100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"]
    )
    return [*counts.values(), failed, llr, ~failed & (llr >= threshold)]


def score_documents(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and the quality columns of every document; one narrow pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    names = [c.split()[0] for c in _SCORED.split(", ")]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = [score_slice(p, shared.value, threshold) for p in slices(batch.column(1))]
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            return pa.record_batch([batch.column(0), *map(pa.array, columns)], ["doc_id", *names])

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", text_of().alias("text")), make, f"doc_id {kind}, {_SCORED}"
    )


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
    target_docs: int = TARGET_DOCS,
) -> DataFrame:
    """Quality columns of every document.

    Null texts count as empty: no words, no lines, base_failed, not kept. Texts of fewer
    than 3 bytes have llr 0. Repeated rows are judged one by one with equal results. An
    empty label table gives llr 0 everywhere, so the base rules decide alone; an empty
    document table gives an empty result. Other columns of `docs` are not read.
    """
    return score_documents(docs, fit_ratios(docs, labels, buckets, target_docs), threshold)


def keep_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that pass, with their own columns. Nothing is shuffled.

    The texts stay Arrow bytes: as pandas values each would be a Python string of up to four
    bytes a character.
    """
    ratios = docs.sparkSession.sparkContext.broadcast(fit_ratios(docs, labels))
    at = docs.columns.index("text")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [score_slice(p, ratios.value, threshold)[-1] for p in slices(batch.column(at))]
            return batch.filter(pa.array(np.concatenate(found))) if found else batch

        return each

    return map_arrow(docs, make, docs.schema)
