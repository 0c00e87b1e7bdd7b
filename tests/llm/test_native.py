from __future__ import annotations

import hashlib
import random
import time
import re
from collections import defaultdict

from conftest_llm import EDGE_TEXTS
from pyspark.sql import functions as F

from seqbraid.llm import line_dedup, sharding, url_filter

BLANK = " \t\n\x0b\f\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(docs: dict[int, str | None]) -> dict[int, tuple]:
    lines = {d: (t or "").split("\n") for d, t in docs.items()}
    where = defaultdict(set)
    for d, ls in lines.items():
        for line in ls:
            key = line.strip(BLANK).translate(FOLD)
            if len(key) >= 10:
                where[key].add(d)
    out = {}
    for d, ls in lines.items():
        kept = [
            x
            for x in ls
            if len(where.get(k := x.strip(BLANK).translate(FOLD), ())) < 2 or min(where[k]) == d
        ]
        out[d] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out


def check_lines(spark, docs, **options):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = line_dedup.dedup_lines(df, **options).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in found} == brute_lines(docs)


def test_lines_against_brute_force(spark):
    draw = random.Random(5)
    pool = ["a common line here", "A COMMON line HERE", " a common line here\t", "short", "", "ÉCLAIRS à gogo",
            "éclairs à gogo", "exactly 10", "nine char", "Ünique line %d" % 1, "x" * 300]
    docs = {i: "\n".join(draw.choices(pool, k=draw.randint(0, 6))) for i in range(60)}
    docs |= {100 + i: t for i, t in enumerate(EDGE_TEXTS)}
    check_lines(spark, docs)
    check_lines(spark, docs, hot_rows=5)


def test_lines_hot_key_and_more_documents(spark):
    docs = {i: "the hot line of all\nown line number %d" % i for i in range(500)}
    check_lines(spark, docs, hot_rows=50)
    df = spark.createDataFrame([(i, "a line in three") for i in range(3)], "doc_id long, text string")
    kept = line_dedup.dedup_lines(df, min_docs=4).filter("n_dropped > 0").count()
    assert kept == 0


def test_lines_edges(spark, edge_docs, no_docs):
    out = line_dedup.dedup_lines(edge_docs)
    assert set(edge_docs.columns) | {"n_lines", "n_dropped"} == set(out.columns)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].text == "" and rows[0].n_lines == 1 and rows[1].n_dropped == 0
    assert rows[6].text == "" and rows[5].text == EDGE_TEXTS[5]
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_lines_of_repeated_and_unnamed_rows(spark):
    line, other = "a line that repeats", "another line that repeats"
    data = [(1, f"{line}\n{other}"), (2, f"x\n{line}\ny"), (2, f"x\n{line}\ny"), (2, f"{other}\n{line}\nz"),
            (None, f"{line}\nown"), (None, f"{line}\nown"), (3, None)]
    out = line_dedup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=repr)
    want = [(1, 2, 0, f"{line}\n{other}"), (2, 3, 1, "x\ny"), (2, 3, 1, "x\ny"), (2, 3, 2, "z"),
            (None, 2, 0, f"{line}\nown"), (None, 2, 0, f"{line}\nown"), (3, 1, 0, "")]
    assert got == sorted(want, key=repr)


def test_very_many_dropped_lines(spark):
    """Positions are looked up in words of bits, so the time grows with the lines."""
    text = "\n".join(f"line number {i} of many" for i in range(100_000))
    docs = {1: text, 2: f"short\n{text}\nshort", 3: "short"}
    began = time.monotonic()
    check_lines(spark, docs)
    assert time.monotonic() - began < 60


def brute_table(names, size):
    def h(name, salt, m):
        return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16) % m

    prefs = [[(h(n, "offset", size) + j * (h(n, "skip", size - 1) + 1)) % size for j in range(size)] for n in names]
    table = {}
    while len(table) < size:
        for i, p in enumerate(prefs):
            if len(table) < size:
                table[next(s for s in p if s not in table)] = i
    return [table[s] for s in range(size)]


def test_shard_table(spark):
    names = sharding.shard_names(7)
    assert sharding.fill_table(names, 101) == brute_table(names, 101)
    full = sharding.fill_table(sharding.shard_names())
    shares = [full.count(i) for i in range(sharding.SHARDS)]
    assert max(shares) - min(shares) <= 1
    fewer = sharding.fill_table(sharding.shard_names()[:-1])
    moved = sum(a != b for a, b in zip(full, fewer, strict=True) if a != sharding.SHARDS - 1)
    assert moved < 0.15 * len(full)


def test_placement(spark, edge_docs, no_docs):
    names = sharding.shard_names(7)
    table = sharding.fill_table(names, 101)
    out = sharding.place(edge_docs.withColumn("shard", F.lit("old")), F.col("doc_id"), names, 101)
    for r in out.collect():
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard, r.shard_name) == (slot, table[slot], names[table[slot]])
    nulls = sharding.place(edge_docs, F.col("key"), names, 101)
    assert nulls.count() == len(EDGE_TEXTS) and nulls.select("shard").distinct().count() == 1
    assert sharding.place(no_docs, F.col("doc_id"), names, 101).count() == 0


def test_write_sharded(spark, edge_docs, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_sharded(edge_docs, F.col("doc_id"), sharding.shard_names(3), path, 2)
    assert spark.read.parquet(path).count() == len(EDGE_TEXTS)


RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
URLS = [
    None, "", "no scheme", "http://", "http://A.Example.COM/en/x", "http://www.example.com/en/x?q=/es/",
    "https://m.www.example.com/en/", "http://example.com", "http://example.com/fr/", "ftp://x.net/es/1#f",
    "http://x.net/en/", "http://notexample.com/en/", "http://com/", "http://a.org/x", "http://ads.b.org/y",
    "http://sub.ads.b.org", "http://b.org?u=http://x.net/es/", "http://é.net/fr/é", "http://x.net:80/es/",
    "http://a..net/es/", "http://x.net/es", "http://a.org/x",
]


def brute_url(url, rules, blocked):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(FOLD), m[2]) if m else ("", "")
    fits = [
        (len(h) + len(p), h + p, v)
        for v, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    hit = any(host == b or host.endswith("." + b) for b in blocked)
    return host, path, None, "block" if hit else "allow"


def judged(spark, urls, blocked, **options):
    pages = spark.createDataFrame(
        [(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, host string"
    )
    block = spark.createDataFrame([(b,) for b in blocked], "host string")
    found = url_filter.judge_urls(pages, RULES, block, **options).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found}


def test_urls_against_brute_force(spark):
    blocked = ["ads.b.org", "nowhere.org"]
    expected = {i: brute_url(u, RULES, blocked) for i, u in enumerate(URLS)}
    assert judged(spark, URLS, blocked) == expected


def test_urls_many_keys_in_parts(spark):
    hosts = [f"h{i}.d{i % 50}.org" for i in range(1500)]
    blocked = hosts[::7]
    urls = [f"http://{h}/p" for h in hosts]
    expected = {i: brute_url(u, RULES, blocked) for i, u in enumerate(urls)}
    assert judged(spark, urls, blocked, part_keys=60) == expected


def test_urls_empty(spark):
    assert judged(spark, [], ["a.org"]) == {}
    assert judged(spark, ["http://a.org/x"], []) == {0: ("a.org", "/x", None, "allow")}


def test_a_task_gives_its_memory_back_also_when_it_is_cut_short(spark, monkeypatch):
    import pyarrow as pa

    from seqbraid.llm import common

    class Frame:
        sparkSession = spark

        def mapInArrow(self, run, schema):
            return run

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_pydict({"x": [1]})
    run = common.map_arrow(Frame(), lambda: lambda b: b, "x long")
    assert len(list(run(iter([batch, batch])))) == 2 and given == [1]
    cut = run(iter([batch, batch]))
    next(cut)
    cut.close()
    assert given == [1, 1]
    monkeypatch.undo()
    common.give_back()


def test_a_worker_keeps_a_table_only_for_tasks_that_ask_for_it(spark):
    from seqbraid.llm import common

    class Frame:
        sparkSession = spark

        def mapInArrow(self, run, schema):
            return run

    built = []

    def build(path):
        built.append(path)
        return [path]

    def asking():
        own = common.kept(build, "file")
        return lambda b: b if own else None

    with_it = common.map_arrow(Frame(), asking, "x long")
    without = common.map_arrow(Frame(), lambda: lambda b: b, "x long")
    for run in (with_it, with_it, without):
        list(run(iter([])))
    assert built == ["file"] and (build, "file") not in common._kept
    list(with_it(iter([])))
    assert built == ["file", "file"]


def test_workers_get_batches_of_few_bytes(spark):
    import pyarrow as pa

    from seqbraid.llm import common

    rows = spark.range(0, 9_000, 1, 1).selectExpr("id", "repeat('x', 2000) as text")

    def make():
        return lambda b: pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    found = common.map_arrow(rows, make, "n long, size long").collect()
    assert sum(r.n for r in found) == 9_000
    assert max(r.size for r in found) <= common.BATCH_BYTES * 1.1
