from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from conftest_llm import EDGE_TEXTS
from pyspark.sql import functions as F

from seqbraid.llm import neardup, quality, textnp, tiling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PUNCT = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def make(spark, texts):
    rows = list(texts.items()) if isinstance(texts, dict) else list(enumerate(texts))
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {
        i + j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(8)
    }
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered)


def draw_texts(n, seed):
    draw = random.Random(seed)
    pool = ["a", "b", "é", "日本", "#x", "long|word", "\n", "\n", "  ", "a b c d e f g h", "\t"]
    return [" ".join(draw.choices(pool, k=draw.randint(0, 30))) for _ in range(n)]


def test_base_counts_against_brute_force():
    texts = draw_texts(300, 1) + [t or "" for t in EDGE_TEXTS]
    for size in (40, 1 << 20):
        for part in textnp.slices(pa.array(texts), size):
            counts = quality.rule_counts(part)
            for r in range(part.rows):
                got = tuple(int(counts[c][r]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
                assert got == brute_rules(texts[part.first + r])


def bucket(gram: bytes) -> int:
    value = np.array([int.from_bytes(gram, "big")], np.uint64)
    return int((textnp.mix(value) % np.uint64(quality.BUCKETS))[0])


def brute_quality(docs, good, threshold=quality.THRESHOLD):
    n = quality.GRAM
    grams = {d: [bucket(b[i : i + n]) for i in range(len(b) - n + 1)] for d, t in docs.items() for b in [(t or "").encode()]}
    raw, target = Counter(), Counter()
    for d, g in grams.items():
        raw.update(g)
        if d in good:
            target.update(g)
    total, t_total = sum(raw.values()), sum(target.values())
    out = {}
    for d, t in docs.items():
        llr = 0.0
        for b in grams[d]:
            p = (raw[b] + 0.5) / (total + 0.5 * quality.BUCKETS)
            q = (target[b] + quality.PRIOR * t_total * p) / (t_total * (1 + quality.PRIOR))
            llr += math.log(q / p)
        llr /= max(len(grams[d]), 1)
        words, *_, repeated = brute_rules(t)
        failed = words < 20 or 100 * repeated > 30 * words
        out[d] = (failed, llr, not failed and llr >= threshold)
    return out


def test_quality_against_brute_force(spark):
    draw = random.Random(2)
    clean = [" ".join(draw.choices(["the", "an", "of", "word", "tion", "ing"], k=40)) for _ in range(12)]
    junk = [" | ".join(draw.choices(["XX", "#1", "$$"], k=40)) for _ in range(6)]
    docs = dict(enumerate([*clean, *junk, *draw_texts(6, 3), *(t for t in EDGE_TEXTS if len(t or "") < 999)]))
    labels = spark.createDataFrame([(i, int(i < 12)) for i in range(18)] + [(None, 1)], "doc_id long, quality int")
    expected = brute_quality(docs, set(range(12)))
    for r in quality.quality_rules(make(spark, docs), labels).collect():
        failed, llr, kept = expected[r.doc_id]
        assert (r.base_failed, r.kept) == (failed, kept) and abs(r.llr - llr) < 1e-9
    kept = {r.doc_id for r in quality.keep_documents(make(spark, docs), labels).collect()}
    assert kept == {d for d, x in expected.items() if x[2]} and kept & set(range(12)) and not kept & set(range(12, 18))


def test_quality_edges(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.quality_rules(edge_docs, none).collect()
    assert len(rows) == len(EDGE_TEXTS) and all(r.llr == 0 for r in rows)
    assert quality.quality_rules(no_docs, none).count() == 0
    assert quality.keep_documents(edge_docs, none).columns == edge_docs.columns


def shingles(text):
    words = WORD.findall((text or "").translate(FOLD))
    if len(words) < 5:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_classes(docs):
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {d: shingles(t) for d, t in docs.items()}
    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            inter, union = sum((sets[a] & sets[b]).values()), sum((sets[a] | sets[b]).values())
            if (docs[a] or "") == (docs[b] or "") or union and 100 * inter >= 80 * union:
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return {d: find(d) for d in docs}


def near_copies(n_groups, seed):
    draw = random.Random(seed)
    vocab = [f"w{i}" for i in range(5000)]
    docs = []
    for _ in range(n_groups):
        base = draw.choices(vocab, k=draw.choice([3, 8, 60, 150]))
        for _ in range(draw.randint(1, 5)):
            copy = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 60))):
                copy[draw.randrange(len(copy))] = draw.choice(vocab)
            docs.append(" ".join(copy))
    draw.shuffle(docs)
    return docs


def test_classes_against_brute_force(spark, edge_docs, no_docs):
    docs = dict(enumerate(near_copies(40, 4) + EDGE_TEXTS + ["A a A a A a A a", "a a a a a a a a", "a a a a a"]))
    got = {r.doc_id: r.class_id for r in neardup.classes(make(spark, docs), hot_rows=3).collect()}
    assert got == brute_classes(docs)
    kept = neardup.keep_first(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(10)) - {1, 6}
    assert neardup.classes(no_docs).count() == 0


def test_one_row_of_each_class_stays_whatever_its_id(spark):
    long = [" ".join(f"{c}{i}" for i in range(60)) for c in "pqrs"]
    data = [(7, long[0], 1), (7, long[0], 2), (9, long[0] + " more", 3), (None, long[0], 4),
            (None, long[1], 5), (None, long[1], 6), (None, long[2], 7), (3, long[3], 8)]
    docs = spark.createDataFrame(data, "doc_id long, text string, _n int")
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    found = sorted((str(r.doc_id), r.text) for r in kept.collect())
    assert found == sorted([("7", long[0]), ("None", long[1]), ("None", long[2]), ("3", long[3])])


def test_rows_without_an_id_are_judged_by_their_text(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    data = [(None, f"x {item} y"), (None, "clean text of its own"), (None, None), (4, item), (5, "clean")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    kept = sorted((str(r.doc_id), r.text) for r in tiling.keep_clean(docs, bench).collect() if r.text)
    assert kept == [("5", "clean"), ("None", "clean text of its own")]
    assert tiling.keep_clean(docs, bench).count() == 3


def test_chain_in_one_bucket(spark):
    """Neighbours are similar, ends are not: one class through links that no leader has."""
    words = [f"u{i}" for i in range(200)]
    docs = {}
    for i in range(12):
        docs[i] = " ".join(words[4 * i : 4 * i + 104])
    got = {r.doc_id: r.class_id for r in neardup.classes(make(spark, docs)).collect()}
    assert got == brute_classes(docs)


def test_large_group_of_loose_copies(spark):
    """Copies of one text, most of them less similar to each other than the threshold."""
    draw = random.Random(9)
    base = [draw.choice([f"b{i}" for i in range(900)]) for _ in range(150)]
    docs = {}
    for i in range(120):
        rate = draw.choice([0.005, 0.01, 0.02, 0.04, 0.08])
        docs[i] = " ".join(f"x{draw.random()}" if draw.random() < rate else w for w in base)
    expected = brute_classes(docs)
    assert 5 < len(set(expected.values())) < 100
    got = {r.doc_id: r.class_id for r in neardup.classes(make(spark, docs), hot_rows=20).collect()}
    assert got == expected


def test_parity_sketches_never_refute_a_similar_pair(spark):
    draw = random.Random(11)
    sets = [np.zeros(0, np.int32), np.array([5], np.int32)]
    for size in (3, 60, 60, 150, 150, 4000):
        base = draw.sample(range(-(2**31), 2**31), size)
        for part in (1, 0.95, 0.9, 0.8, 0.6):
            other = draw.sample(range(-(2**31), 2**31), size - int(part * size))
            sets.append(np.unique(np.array(base[: int(part * size)] + other, np.int64)).astype(np.int32))
    rows = [
        (i, x.tolist(), y.tolist())
        for i, (x, y) in enumerate(zip(sets, neardup.parity_sketches(sets), strict=True))
    ]
    made = spark.createDataFrame(rows, "i int, elems array<int>, p array<long>")
    a = made.select("i", F.col("p").alias("x"), F.size("elems").alias("n"))
    b = made.select(F.col("i").alias("j"), F.col("p").alias("y"), F.size("elems").alias("m"))
    passed = {
        (r.i, r.j)
        for r in a.join(b, F.col("i") < F.col("j"))
        .filter(neardup.may_be_similar(80, "x", "y", "n", "m"))
        .collect()
    }
    similar, short = set(), set()
    for i, x in enumerate(sets):
        for j in range(i + 1, len(sets)):
            shared = len(np.intersect1d(x, sets[j]))
            if 100 * shared >= 80 * (len(x) + len(sets[j]) - shared):
                similar.add((i, j))
            elif max(len(x), len(sets[j])) <= 150 and shared < 0.7 * max(len(x), len(sets[j])):
                short.add((i, j))
    assert len(similar) >= 12 and similar <= passed
    assert len(short) > 200 and len(short & passed) == 0


def test_signatures_estimate_weighted_similarity():
    draw = random.Random(6)
    base = [f"t{i}" for i in range(300)] * 2
    other = [draw.choice(base) if draw.random() < 0.04 else w for w in base]
    texts = [" ".join(base), " ".join(other), " ".join(base[:3])]
    part = next(textnp.slices(pa.array(texts)))
    element, row = neardup.elements(part)
    sign = neardup.signatures(element, row, 3, 4000)
    a, b = shingles(texts[0]), shingles(texts[1])
    exact = sum((a & b).values()) / sum((a | b).values())
    assert abs((sign[0] == sign[1]).mean() - exact) < 0.04
    assert (sign[2] != 0).all()


def tokens(text):
    out = []
    for word in WORD.findall((text or "").translate(FOLD)):
        lo, hi = 0, len(word)
        while lo + 1 < hi and word[lo] in PUNCT:
            lo += 1
        while lo + 1 < hi and word[hi - 1] in PUNCT:
            hi -= 1
        out.append(word[lo:hi])
    return out


def brute_tiles(item, doc, k):
    """Tokens of the item under greedy tiles, by looking for the longest free match again and again."""
    in_item, in_doc, total = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (0, 0, 0)
        prev = [0] * (len(item) + 1)
        for x, word in enumerate(doc):
            row = [0] * (len(item) + 1)
            for y, other in enumerate(item):
                if word == other and not in_doc[x] and not in_item[y]:
                    row[y + 1] = prev[y] + 1
                    if row[y + 1] > best[0]:
                        best = (row[y + 1], x, y)
            prev = row
        n, x, y = best
        if n < k:
            return total
        for j in range(n):
            in_doc[x - j] = in_item[y - j] = True
        total += n


def test_tiling_against_brute_force(spark):
    draw = random.Random(7)
    vocab = [f"v{i}" for i in range(400)]
    items = [draw.choices(vocab, k=draw.choice([3, 12, 40])) for _ in range(12)]
    docs = []
    for _ in range(60):
        item = draw.choice(items)
        parts = [item[i : i + draw.choice([6, 10, 50])] for i in range(0, len(item), 6)]
        draw.shuffle(parts)
        doc = draw.choices(vocab, k=20) + [w for p in parts[:4] for w in p] + draw.choices(vocab, k=9)
        docs.append(" ".join(w.upper() + "," if draw.random() < 0.2 else w for w in doc))
    bench = [" ".join(i) + "." for i in items]
    pairs = spark.createDataFrame(list(enumerate([*bench, None, ""])), "item_id long, text string")
    expected = {
        (d, i): n
        for d, doc in enumerate(docs)
        for i, item in enumerate(bench)
        if (n := brute_tiles(tokens(item), tokens(doc), 5)) >= 0.5 * len(tokens(item))
    }
    assert len(expected) > 20
    for block in (10, 1 << 20):
        found = tiling.contaminated(make(spark, docs), pairs, block_bytes=block).collect()
        assert {(r.doc_id, r.item_id): r.n_tokens for r in found} == expected
    clean = tiling.keep_clean(make(spark, docs), pairs)
    assert {r.doc_id for r in clean.collect()} == set(range(60)) - {d for d, _ in expected}


def test_tiling_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, EDGE_TEXTS[5], 0)], "item_id long, text string, doc_id int")
    found = tiling.contaminated(edge_docs, bench)
    assert sorted(r.doc_id for r in found.collect()) == [5, 6]
    assert tiling.keep_clean(edge_docs, bench).columns == edge_docs.columns
    assert tiling.contaminated(no_docs, bench).count() == 0
    assert tiling.contaminated(edge_docs, bench.limit(0)).count() == 0


def test_repeated_passage_stops_early():
    item = np.arange(40)
    doc_pos = np.concatenate([np.arange(36) + 40 * r for r in range(500)])
    found = tiling.tiles(doc_pos, np.tile(item[:36], 500), 40)
    assert found == [(0, 0, 40)]


def test_grams_do_not_cross_texts():
    part = next(textnp.slices(pa.array(["a b", "c d e"])))
    words = textnp.words(part)
    hashes = textnp.range_hashes(part, words.start, words.end)
    assert textnp.gram_hashes(hashes, words.row, 3)[1].tolist() == [2]
    groups = defaultdict(set)
    for h, s, e in zip(hashes, words.start, words.end, strict=True):
        groups[int(h)].add(part.data[s:e].tobytes())
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == 5


def test_kept_documents_stay_arrow_bytes(spark):
    """As pandas values the texts would be Python strings, the largest thing in a worker."""
    plain = " ".join(f"word{i}" for i in range(40))
    texts = [plain, "short", None, "x " * 400, "\U0001f600 " + plain.replace("word", "term")]
    docs = spark.createDataFrame([(i, t, "n" * i) for i, t in enumerate(texts)], "doc_id long, text string, z string")
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    kept = quality.keep_documents(docs, labels)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" in plan
    verdicts = quality.quality_rules(docs, labels).filter("kept").select("doc_id")
    expected = docs.join(verdicts, "doc_id").select(*docs.columns)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, expected.collect()))
    assert 0 < kept.count() < len(texts)
