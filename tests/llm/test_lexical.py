from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest_llm import EDGE_TEXTS

from seqbraid.llm import lexical
from seqbraid.llm.q_search import op12_ranked_search
from seqbraid.llm.registry import ORACLES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k):
    counted = [(d, Counter(cut(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, c), n in zip(counted, sizes, strict=True):
            score = 0
            for t in set(cut(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 10 + 90 * n * n_docs // total
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is not None, doc))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, x[2], -x[0]) for r, x in enumerate(scored[:k], 1)]
    return Counter(out)


def draw_docs(draw, n):
    words = [f"t{int(draw.paretovariate(0.6)) % 400}" for _ in range(3000)] + ["Ünï", "日本", "A", "a"]
    docs = [(i, " ".join(draw.choices(words, k=draw.choice([0, 1, 5, 30, 200])))) for i in range(n)]
    docs += [(n + i, docs[draw.randrange(n)][1]) for i in range(n // 3)]
    return docs, words


@pytest.mark.parametrize("k, block_bytes", [(10, 1 << 20), (3, 300)])
def test_ranks_equal_brute_force(spark, k, block_bytes):
    draw = random.Random(k)
    docs, words = draw_docs(draw, 600)
    docs += [(None, "t1 t2 t3"), (None, None), (4, docs[4][1]), (9_000, "t1-t2_T3;t1")]
    items = [(i, " ".join(draw.choices(words, k=draw.choice([0, 1, 4, 25])))) for i in range(40)]
    items += [(3, items[3][1]), (50, None), (51, "never seen"), (None, "t1 t2")]
    got = lexical.ranked(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
        spark.createDataFrame(items, "item_id long, text string"),
        k,
        block_bytes,
    )
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert (Counter(map(tuple, got.collect())) == brute(docs, items, k)) is True


def test_edge_documents_and_empty_tables(spark, edge_docs, no_docs):
    items = [(1, "Words in WORDS here"), (2, "café 日本語 w5x5"), (3, "\x00 !")]
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as doc_id")
    got = Counter(map(tuple, lexical.ranked(edge_docs, table).collect()))
    assert (got == brute(list(enumerate(EDGE_TEXTS)), items, 10)) is True
    assert lexical.ranked(no_docs, table).count() == 0
    assert lexical.ranked(edge_docs, table.limit(0)).count() == 0


def test_nodes_bound_what_is_below_and_batches_are_left_out():
    draw = np.random.default_rng(5)
    n_docs, n_terms = 3000, 200
    # Ten groups of documents, each with terms of its own.
    group = np.arange(n_docs) // 300
    row = np.repeat(np.arange(n_docs), 10)
    term = group[row] * 20 + draw.integers(0, 20, len(row))
    key = np.unique(row * n_terms + term)
    row, term = key // n_terms, key % n_terms
    value = draw.integers(1, 1_000_000, len(row)).astype(float)
    weights = draw.integers(1, 9000, n_terms).astype(float)
    of_item = [np.unique(draw.integers(0, 20, 6) + 20 * (i % 10)) for i in range(50)]
    root = lexical.item_tree(of_item, weights)
    tree = lexical.DocumentTree(np.arange(n_docs), row, term, value, n_terms)
    dense = np.zeros((n_docs, n_terms))
    dense[row, term] = value
    want = np.stack([dense[:, t] @ weights[t] for t in of_item])
    for level, maxima in enumerate(tree.levels):
        bound = tree.bounds(level, np.arange(len(maxima)), root)
        size = tree.leaf * lexical.FAN_OUT**level
        for node in range(len(maxima)):
            assert bound[node] >= want[:, tree.ids[node * size : (node + 1) * size]].max()
    best = lexical.Best(10, np.zeros(len(of_item), np.int64))
    scored = lexical.search(tree, root, best)
    for i in range(len(of_item)):
        order = np.lexsort((np.arange(n_docs), -want[i]))[:10]
        assert best.docs[i].tolist() == order.tolist() and best.found[i].tolist() == want[i][order].tolist()
    assert scored < 0.2 * want.size


def test_query_equals_oracle(spark):
    folder = "/root/testdata/sf0.001"
    got = op12_ranked_search(spark, folder)
    with duckdb.connect() as con:
        for name in ("documents", "benchmark"):
            con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
        result = con.execute(ORACLES["op12_ranked_search"])
        assert [d[0] for d in result.description] == got.columns
        assert (Counter(result.fetchall()) == Counter(map(tuple, got.collect()))) is True
