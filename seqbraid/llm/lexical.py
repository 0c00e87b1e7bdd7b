"""Ranked lexical search of all documents for every item, by a dual tree.

The score of a document for an item is an inner product: a weight for each term of the
item times the document's saturated frequency of that term. Both sides stand in trees whose
nodes hold the greatest value of every coordinate below them. The inner product of two
nodes bounds every score below them, so a pair of nodes whose bound is under the weakest
k-th score of its items is left out with all items and documents below it. The result is
exact: a bound is a sum of integers below 2**53, and equal scores are never left out.

1. Terms of the items are numbered, in blocks of at most `block_bytes` of their text.
2. One pass over the documents writes their frequencies of these terms and their lengths.
3. Document counts follow from that table; weights are computed from them.
4. A pilot ranks one of PILOT documents by hash; its k-th scores are lower limits for step 5.
5. All documents are searched. Every task builds trees over a few thousand documents at a
   time and keeps the best `k` of each item; the best of all tasks are ranked.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqbraid.llm.common import map_arrow, materialise, ready, text_of

BLOCK_BYTES = 1 << 20
PILOT = 64
# Documents below a root, and the fan-out of both trees.
ROOT_DOCS = 4096
FAN_OUT = 8
SLICE_BYTES = 4 << 20
_NO_ID = np.iinfo(np.int64).min

# Term characters are ASCII letters and digits and all bytes of other characters; letters fold.
_FOLDED = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLDED).split()


@dataclass
class Items:
    """Items of one block and the numbers of their distinct terms."""

    ids: list
    vocabulary: dict[bytes, int]
    of_item: list[np.ndarray]


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[Items]:
    """The items in blocks of bounded text; an item without terms is in none."""
    own = Items([], {}, [])
    size = 0
    for item_id, text in items.toLocalIterator():
        found = dict.fromkeys(terms(text.encode()))
        if not found:
            continue
        if own.ids and size + len(text) > block_bytes:
            yield own
            own, size = Items([], {}, []), 0
        numbers = [own.vocabulary.setdefault(t, len(own.vocabulary)) for t in found]
        own.ids.append(item_id)
        own.of_item.append(np.array(numbers, np.int64))
        size += len(text)
    if own.ids:
        yield own


def term_vectors(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n (terms with repeats), terms and tf (those of the vocabulary) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def count(texts: list[bytes], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, ...]:
        cut = [terms(text) for text in texts]
        sizes = np.array([len(t) for t in cut], np.int64)
        number = map(vocabulary.get, itertools.chain.from_iterable(cut), itertools.repeat(-1))
        number = np.fromiter(number, np.int64, int(sizes.sum()))
        row = np.repeat(np.arange(len(cut)), sizes)[number >= 0]
        key, tf = np.unique(row * len(vocabulary) + number[number >= 0], return_counts=True)
        each = np.bincount(key // len(vocabulary), minlength=len(cut))
        return sizes, each, key % len(vocabulary), tf

    def make():
        vocabulary = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).cast(pa.large_binary())
            ends = np.cumsum([0, *map(len, texts.to_pylist())])
            found, row = [], 0
            while row < len(texts):
                last = int(np.searchsorted(ends, ends[row] + SLICE_BYTES, "right")) - 1
                last = min(max(last, row + 1), len(texts))
                found.append(count(texts.slice(row, last - row).to_pylist(), vocabulary))
                row = last
            n, held, number, tf = map(np.concatenate, zip(*found, strict=True))
            offsets = pa.array(np.concatenate(([0], np.cumsum(held))).astype(np.int32))
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (number, tf)
            ]
            return pa.record_batch([batch.column(0), pa.array(n), *lists], ["doc_id", "n", "terms", "tf"])

        return each

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_arrow(texts, make, "doc_id long, n long, terms array<int>, tf array<int>")


def document_counts(vectors: DataFrame, n_terms: int) -> np.ndarray:
    """The number of documents that hold each term; one partial count per batch is shuffled."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
            at = np.flatnonzero(own)
            return pa.record_batch([pa.array(at), pa.array(own[at])], ["term", "n"])

        return each

    partial = map_arrow(vectors.select("terms"), make, "term long, n long")
    out = np.zeros(n_terms, np.int64)
    for term, n in partial.groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


@dataclass
class ItemNode:
    """Items below a node, their united terms with weights, and the children."""

    items: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    children: list[ItemNode]


def item_tree(of_item: list[np.ndarray], weights: np.ndarray) -> ItemNode:
    """Items with the same frequent terms are near each other; a node has FAN_OUT children."""
    frequent = [tuple(sorted(own[np.lexsort((own, weights[own]))[:4]].tolist())) for own in of_item]
    nodes = [
        ItemNode(np.array([i]), of_item[i], weights[of_item[i]], [])
        for i in sorted(range(len(of_item)), key=lambda i: (frequent[i], i))
    ]
    while len(nodes) > 1:
        parents = []
        for at in range(0, len(nodes), FAN_OUT):
            below = nodes[at : at + FAN_OUT]
            own = np.unique(np.concatenate([x.terms for x in below]))
            parents.append(ItemNode(np.concatenate([x.items for x in below]), own, weights[own], below))
        nodes = parents
    return nodes[0]


class DocumentTree:
    """Coordinate maxima of some documents, level by level, and their postings.

    Level 0 has a row for FAN_OUT**2 documents, the last level one row.
    """

    def __init__(self, ids: np.ndarray, row: np.ndarray, term: np.ndarray, value: np.ndarray, n_terms: int):
        order = np.lexsort((value, row))
        # Documents with the same strongest term stand next to each other.
        strongest = np.full(len(ids), -1, np.int64)
        strongest[row[order]] = term[order]
        place = np.empty(len(ids), np.int64)
        self.order = np.argsort(strongest, kind="stable")
        place[self.order] = np.arange(len(ids))
        self.ids, row = ids[self.order], place[row]
        by_term = np.lexsort((row, term))
        self.row, self.value = row[by_term], value[by_term]
        self.first = np.searchsorted(term[by_term], np.arange(n_terms + 1))
        self.leaf = FAN_OUT * FAN_OUT
        maxima = np.zeros((-(-len(ids) // self.leaf), n_terms))
        np.maximum.at(maxima, (row // self.leaf, term), value)
        self.levels = [maxima]
        while len(self.levels[-1]) > 1:
            self.levels.append(np.maximum.reduceat(self.levels[-1], np.arange(0, len(self.levels[-1]), FAN_OUT)))

    def bounds(self, level: int, nodes: np.ndarray, item: ItemNode) -> np.ndarray:
        return self.levels[level][np.ix_(nodes, item.terms)] @ item.weights

    def scores(self, item: ItemNode, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of some leaves and their scores for a single item."""
        at = np.concatenate([np.arange(self.first[t], self.first[t + 1]) for t in item.terms])
        weight = np.repeat(item.weights, self.first[item.terms + 1] - self.first[item.terms])
        total = np.bincount(self.row[at], self.value[at] * weight, len(self.ids))
        inside = np.zeros(len(self.levels[0]), bool)
        inside[leaves] = True
        docs = np.flatnonzero(inside[np.arange(len(self.ids)) // self.leaf] & (total > 0))
        return docs, total[docs]


class Best:
    """The k best documents of every item so far, and the score that a further one must reach."""

    def __init__(self, k: int, floors: np.ndarray):
        self.k = k
        self.limits = floors.astype(np.float64)
        self.docs = [np.zeros(0, np.int64) for _ in floors]
        self.found = [np.zeros(0) for _ in floors]

    def add(self, item: int, docs: np.ndarray, found: np.ndarray) -> None:
        docs = np.concatenate((self.docs[item], docs))
        found = np.concatenate((self.found[item], found))
        order = np.lexsort((docs, -found))[: self.k]
        self.docs[item], self.found[item] = docs[order], found[order]
        if len(order) == self.k:
            self.limits[item] = max(self.limits[item], self.found[item][-1])


def search(tree: DocumentTree, root: ItemNode, best: Best) -> int:
    """Offer every document that can reach an item's limit; returns the number of scored pairs."""
    top = len(tree.levels) - 1
    open_pairs = [(root, top, np.arange(len(tree.levels[top])))]
    scored = 0
    while open_pairs:
        item, level, nodes = open_pairs.pop()
        bounds = tree.bounds(level, nodes, item)
        nodes = nodes[(bounds >= best.limits[item.items].min()) & (bounds > 0)]
        if not len(nodes):
            continue
        if level:
            below = (nodes[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
            below = below[below < len(tree.levels[level - 1])]
            open_pairs += [(child, level - 1, below) for child in item.children or [item]]
        elif item.children:
            open_pairs += [(child, 0, nodes) for child in item.children]
        else:
            own = int(item.items[0])
            docs, found = tree.scores(item, nodes)
            scored += len(docs)
            keep = found >= best.limits[own]
            best.add(own, tree.ids[docs[keep]], found[keep])
    return scored


def saturated(tf: np.ndarray, n: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """A document's coordinate for a term of frequency tf, among n terms; 64-bit integers."""
    m = 10 + (90 * n * n_docs) // all_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _searched(
    vectors: DataFrame, root: ItemNode, floors: np.ndarray, k: int, n_terms: int, n_docs: int, all_terms: int
) -> DataFrame:
    """item (number), doc_id, score: the best k of every task."""
    spark = vectors.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast((root, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, limits = shared.value
        best = Best(k, limits)
        for batch in batches:
            for at in range(0, batch.num_rows, ROOT_DOCS):
                part = batch.slice(at, ROOT_DOCS)
                ids = part.column(0).fill_null(_NO_ID).to_numpy()
                held = part.column(2).value_lengths().to_numpy()
                row = np.repeat(np.arange(len(ids)), held)
                term = part.column(2).flatten().to_numpy().astype(np.int64)
                tf = part.column(3).flatten().to_numpy().astype(np.int64)
                value = saturated(tf, part.column(1).to_numpy()[row], n_docs, all_terms)
                search(DocumentTree(ids, row, term, value.astype(np.float64), n_terms), items, best)
        found = [(i, len(docs)) for i, docs in enumerate(best.docs) if len(docs)]
        if found:
            docs = np.concatenate([best.docs[i] for i, _ in found])
            yield pa.record_batch(
                [
                    pa.array(np.repeat([i for i, _ in found], [n for _, n in found])),
                    pa.array(docs, mask=docs == _NO_ID),
                    pa.array(np.concatenate([best.found[i] for i, _ in found]).astype(np.int64)),
                ],
                ["item", "doc_id", "score"],
            )

    return vectors.mapInArrow(run, "item long, doc_id long, score long")


def _placed(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _ranked_block(docs: DataFrame, items: Items, kind, k: int) -> DataFrame:
    vectors = materialise(term_vectors(docs, items))
    n_docs, all_terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_counts(vectors, len(items.vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.float64)
    root = item_tree(items.of_item, weights)
    numbers = (len(items.vocabulary), n_docs, max(all_terms, 1))
    floors = np.zeros(len(items.ids), np.int64)
    pilot = vectors.filter(F.pmod(F.xxhash64("doc_id"), F.lit(PILOT)) == 0)
    for item, score in (
        _placed(_searched(pilot, root, floors, k, *numbers), k)
        .filter(F.col("rank") == k)
        .select("item", "score")
        .collect()
    ):
        floors[item] = score
    found = _placed(_searched(vectors, root, floors, k, *numbers), k)
    names = docs.sparkSession.createDataFrame(
        list(enumerate(items.ids)), f"item long, item_id {kind.simpleString()}"
    )
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of every item.

    Only scores above 0 count; equal scores rank by ascending doc_id, a null id first. Null
    and empty texts on either side have no terms and match nothing. Every row of `docs` is
    ranked for itself, so a repeated row may stand twice; an item that is repeated is answered
    as often, with ranks of its own. Texts of any length are counted whole. An empty table on
    either side gives an empty result. Columns other than doc_id, text and item_id, text are
    not read; doc_id is read as long.
    """
    kind = items.schema["item_id"].dataType
    texts = items.filter("text is not null").select("item_id", "text")
    found = [_ranked_block(docs, own, kind, k) for own in item_blocks(texts, block_bytes)]
    if found:
        return reduce(DataFrame.unionByName, found)
    return docs.sparkSession.createDataFrame(
        [], f"item_id {kind.simpleString()}, rank int, doc_id long, score long"
    )
