"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes.

Tokens are words without ASCII punctuation at their ends, A-Z folded. Rolling hashes of
`min_match` tokens are the seeds; documents and benchmark items meet where they
share one. Seeds on one diagonal run together into maximal matches; the longest is
marked as a tile, matches it overlaps are cut to their unmarked rest, and so on until
no unmarked match of `min_match` tokens is left. The coverage of an item is the share
of its tokens under tiles, so passages that were moved around still count.

The benchmark is the stated query set: it goes to the tasks in blocks of at most
`block_bytes` of text, one pass over the documents for each block. Documents are
never shuffled, and a document needs memory for its own tokens only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqbraid.llm.common import map_arrow, materialise, text_of
from seqbraid.llm.textnp import (
    Slice,
    gram_hashes,
    range_hashes,
    slices,
    trimmed,
    words,
)

MIN_MATCH = 5
MIN_COVERAGE = 0.5
BLOCK_BYTES = 32 << 20
_SIEVE_BITS = 22


@dataclass
class Block:
    """Seeds of some benchmark items, sorted by hash."""

    ids: list
    lengths: np.ndarray
    seeds: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    sieve: np.ndarray


def _tokens(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes, their text, and the number of tokens before each text."""
    found = trimmed(part, words(part))
    hashes = range_hashes(part, found.start, found.end, lower=True)
    return hashes, found.row, np.concatenate(([0], np.cumsum(found.counts)))


def make_block(ids: list, texts: list[str], min_match: int = MIN_MATCH) -> Block:
    seeds, item, pos, lengths = [], [], [], []
    for part in slices(pa.array(texts, pa.string())):
        hashes, row, before = _tokens(part)
        grams, at = gram_hashes(hashes, row, min_match)
        seeds.append(grams)
        item.append(row[at] + part.first)
        pos.append(at - before[row[at]])
        lengths.append(np.diff(before))
    grams = np.concatenate(seeds)
    order = np.argsort(grams, kind="stable")
    sieve = np.zeros(1 << _SIEVE_BITS, bool)
    sieve[grams >> np.uint64(64 - _SIEVE_BITS)] = True
    return Block(
        ids,
        np.concatenate(lengths),
        grams[order],
        np.concatenate(item)[order],
        np.concatenate(pos)[order],
        sieve,
    )


def tiles(
    doc_pos: np.ndarray, item_pos: np.ndarray, n_item: int, min_match: int = MIN_MATCH
) -> list[tuple[int, int, int]]:
    """Greedy tiles (document position, item position, length) from all shared seeds of a pair."""
    diagonal = doc_pos - item_pos
    order = np.lexsort((doc_pos, diagonal))
    d, i, g = doc_pos[order], item_pos[order], diagonal[order]
    head = np.ones(len(d), bool)
    head[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1] + 1)
    at = np.flatnonzero(head)
    runs = np.diff(np.append(at, len(d)))
    heap = [(-int(r) - min_match + 1, int(d[a]), int(i[a])) for a, r in zip(at, runs, strict=True)]
    heapq.heapify(heap)
    base = int(d.min()) if len(d) else 0
    in_doc = np.zeros((int(d.max()) - base + min_match) if len(d) else 0, bool)
    in_item = np.zeros(n_item, bool)
    found = []
    while heap and not in_item.all():
        length, x, y = heapq.heappop(heap)
        length = -length
        free = ~(in_doc[x - base : x - base + length] | in_item[y : y + length])
        if free.all():
            in_doc[x - base : x - base + length] = True
            in_item[y : y + length] = True
            found.append((x, y, length))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
        for lo, hi in zip(edge[::2], edge[1::2], strict=True):
            if hi - lo >= min_match:
                heapq.heappush(heap, (int(lo - hi), x + int(lo), y + int(lo)))
    return found


def match_slice(
    part: Slice, block: Block, min_match: int, min_coverage: float
) -> Iterator[tuple[int, int, int, int]]:
    """(row of the slice, item index, tiled tokens, number of tiles) of the pairs over the limit."""
    hashes, row, before = _tokens(part)
    grams, at = gram_hashes(hashes, row, min_match)
    near = block.sieve[grams >> np.uint64(64 - _SIEVE_BITS)]
    grams, at = grams[near], at[near]
    lo = np.searchsorted(block.seeds, grams, "left")
    n = np.searchsorted(block.seeds, grams, "right") - lo
    if not n.sum():
        return
    seed = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    at = np.repeat(at, n)
    text, item, item_pos = row[at], block.item[seed], block.pos[seed]
    doc_pos = at - before[text]
    order = np.lexsort((item_pos, item, text))
    text, item, item_pos, doc_pos = (x[order] for x in (text, item, item_pos, doc_pos))
    head = np.ones(len(text), bool)
    head[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
    start = np.flatnonzero(head)
    # All seeds of a pair together cover at least what its tiles cover.
    step = np.full(len(text), min_match)
    step[1:][~head[1:]] = np.minimum(min_match, np.diff(item_pos)[~head[1:]])
    most = np.add.reduceat(step, start)
    stop = np.append(start[1:], len(text))
    for a, b, cover in zip(start, stop, most, strict=True):
        size = int(block.lengths[item[a]])
        if cover < min_coverage * size:
            continue
        found = tiles(doc_pos[a:b], item_pos[a:b], size, min_match)
        tiled = sum(t[2] for t in found)
        if tiled >= min_coverage * size:
            yield int(text[a]), int(item[a]), tiled, len(found)


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for item, text in benchmark.filter("text is not null").toLocalIterator():
        if ids and size + len(text) > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(item)
        texts.append(text)
        size += len(text)
    if ids:
        yield ids, texts


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    min_match: int = MIN_MATCH,
    min_coverage: float = MIN_COVERAGE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, item_id, coverage, n_tokens, n_tiles: the items whose text a document gives away.

    One row for every document and item with at least `min_coverage` of the item's tokens
    under tiles. Items of fewer than `min_match` tokens have no seed and never match;
    null and empty texts on either side match nothing. Repeated documents, and repeated
    items, are reported each. An empty table on either side gives an empty result;
    columns other than doc_id, text and item_id, text are not read.
    """
    spark = docs.sparkSession
    kinds = [docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType]
    schema = (
        f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, "
        "coverage double, n_tokens long, n_tiles long"
    )
    names = ["doc_id", "item_id", "coverage", "n_tokens", "n_tiles"]
    texts = docs.select("doc_id", text_of().alias("text"))

    def search(block: Block) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def make():
            def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
                own = shared.value
                hits = [
                    (part.first + r, i, tiled, n)
                    for part in slices(batch.column(1))
                    for r, i, tiled, n in match_slice(part, own, min_match, min_coverage)
                ]
                if not hits:
                    return None
                rows, items, tiled, n = zip(*hits, strict=True)
                share = [t / int(own.lengths[i]) for t, i in zip(tiled, items, strict=True)]
                return pa.record_batch(
                    [
                        batch.column(0).take(pa.array(rows)),
                        pa.array([own.ids[i] for i in items]),
                        pa.array(share),
                        pa.array(tiled, pa.int64()),
                        pa.array(n, pa.int64()),
                    ],
                    names,
                )

            return each

        return map_arrow(texts, make, schema)

    found = [
        materialise(search(make_block(ids, items, min_match)))
        for ids, items in _blocks(benchmark.select("item_id", "text"), block_bytes)
    ]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that give away no item, with their own columns.

    Rows with one doc_id are one document and go together. A row without an id is judged by
    its own text. Null and empty texts stay; an empty table on either side drops nothing.
    """
    hits = contaminated(docs, benchmark, **options).select("doc_id").distinct()
    named = docs.filter("doc_id is not null").join(materialise(hits), "doc_id", "left_anti")
    of_text = F.xxhash64("text")
    unnamed = docs.filter("doc_id is null")
    found = contaminated(unnamed.select(of_text.alias("doc_id"), "text"), benchmark, **options)
    found = materialise(found.select(F.col("doc_id").alias("_keep_clean_text")).distinct())
    unnamed = unnamed.withColumn("_keep_clean_text", of_text).join(found, "_keep_clean_text", "left_anti")
    return named.select(*docs.columns).unionByName(unnamed.select(*docs.columns))
