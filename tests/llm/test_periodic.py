from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from conftest_llm import EDGE_TEXTS
from pyspark.sql import functions as F

from seqbraid.llm import periodic
from seqbraid.llm.q_search import op11_periodic_runs, planted

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """All runs by trying every period at every place."""
    best = {}
    n = len(words)
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                best.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in best.items())


def brute_answer(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else None
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    dropped = {i for s, k, q in found for i in range(s + q, s + k)}
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    table = "".join(f"{s},{k},{q}\n" for s, k, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (table, kept)]
    head = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *head, *sha)


def draw_words(draw):
    """Words with runs of many periods, some inside others, some broken or next to each other."""
    out = []
    for _ in range(draw.randint(0, 6)):
        unit = [draw.choice("abcdef") for _ in range(draw.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33]))]
        if draw.random() < 0.3:
            unit = unit[:3] * draw.randint(2, 5) + unit
        times = draw.choice([0.5, 1, 3, 3.9, 4, 4.1, 5, 9])
        stretch = (unit * 10)[: int(len(unit) * times)]
        if stretch and draw.random() < 0.2:
            stretch[draw.randrange(len(stretch))] = "x"
        out += stretch
        out += [f"n{draw.randrange(1000)}" for _ in range(draw.choice([0, 0, 1, 5]))]
    return out


def found_runs(texts):
    sizes = np.array([len(t) for t in texts], np.int64)
    start, length, period = periodic.runs(periodic._numbered(texts), sizes)
    return list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))


def test_runs_against_brute_force():
    draw = random.Random(11)
    texts = [draw_words(draw) for _ in range(1500)]
    texts += [[draw.choice("ab") for _ in range(draw.randint(0, 120))] for _ in range(300)]
    texts += [[], ["a"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b"] * 3 + ["a"], ["a"] * 500]
    want, at = [], 0
    for t in texts:
        want += [(s + at, n, p) for s, n, p in brute_runs(t)]
        at += len(t)
    assert (found_runs(texts) == sorted(want)) is True
    assert len(want) > 800 and len({p for _, _, p in want}) > 20


def test_long_periods():
    draw = random.Random(3)
    for period in (63, 64, 65, 127, 128, 500, 1023, 1024, 3000):
        unit = [f"w{draw.randrange(50)}" for _ in range(period)]
        unit[0] = "only"
        for size in (4 * period - 1, 4 * period, 4 * period + period // 2):
            words = ["left", *(unit * 5)[:size], "right", "end"]
            want = [(1, size, period)] if size >= 4 * period else []
            assert [r for r in found_runs([words]) if r[2] >= 50] == want


def test_short_words_of_fibonacci_have_many_squares_and_no_run():
    a, b = ["a"], ["a", "b"]
    while len(b) < 6000:
        a, b = b, b + a
    assert found_runs([b]) == brute_runs(b[:1000]) == []


def test_find_runs_on_edge_documents(spark, edge_docs, no_docs):
    out = periodic.find_runs(edge_docs)
    assert out.columns == ["doc_id", "runs", "collapsed"]
    rows = {r["doc_id"]: r for r in out.collect()}
    for i, text in enumerate(EDGE_TEXTS[:-1]):
        assert [tuple(x) for x in rows[i]["runs"]] == []
        assert rows[i]["collapsed"] == " ".join(WORD.findall(text or ""))
    # The long text repeats every 977 * 31 words, fewer than four times over.
    assert rows[len(EDGE_TEXTS) - 1]["runs"] == []
    assert periodic.find_runs(no_docs).count() == 0


def test_repeated_and_null_ids_keep_their_rows(spark):
    rows = [(None, "a b " * 6), (None, None), (5, "x " * 9 + "y"), (5, "x " * 9 + "y"), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted(
        (str(r["doc_id"]), [tuple(x) for x in r["runs"]], r["collapsed"])
        for r in periodic.find_runs(docs).collect()
    )
    assert got == [
        ("5", [(0, 9, 1)], "x y"),
        ("5", [(0, 9, 1)], "x y"),
        ("6", [], ""),
        ("None", [], ""),
        ("None", [(0, 12, 2)], "a b"),
    ]


def test_query_against_brute_force(spark, tmp_path):
    draw = random.Random(2)
    texts = [" ".join(draw_words(draw)) for _ in range(300)]
    texts += [" ".join(draw.choices("abcdefghij", k=draw.randint(0, 400))) for _ in range(300)]
    texts += [None, "", "  \n", "one", "a\x0bb\x1cc\x85d e\x00f", "é " * 7]
    rows = [*enumerate(texts), (None, "a " * 7), (None, None), (3, "b " * 8), (-20, "c d " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want = sorted((brute_answer(*r) for r in rows), key=repr)
    assert (got == want) is True


def test_planted_texts_change_only_every_tenth(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a b c d e f").alias("text"))
    changed = planted(docs).filter("text <> 'a b c d e f'").count()
    assert 0 < changed <= sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(200))
