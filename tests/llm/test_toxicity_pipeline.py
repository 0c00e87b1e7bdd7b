from __future__ import annotations

import random
import zlib

import public_tokenizers
import sentencepiece
from conftest_llm import EDGE_TEXTS
from test_filters import brute_classes, brute_quality, brute_tiles, tokens
from test_native import brute_lines

import corpus_pipeline
from seqbraid.llm import toxicity
from seqbraid.llm.common import documents, table

SF = "/root/testdata/sf0.01"


def grammar():
    return toxicity.Grammar({"moron": 3.0}, {"scumm": 2.0})


def test_clause_contexts():
    own = grammar()
    assert own.clause("such a moron here") == [("plain", 3.0, "moron")]
    assert own.clause("you are a moron") == [("targeted", 3.0, "moron")]
    assert own.clause("he is not a moron") == [("negated", 3.0, "moron")]
    assert own.clause("she said you are a moron") == [("reported", 3.0, "moron")]
    assert own.clause("i will kill you") == [("threats", 3.0, "kill")]
    assert own.clause("they kill time") == own.clause("kill time") == []
    assert own.clause("scummiest thing") == [("plain", 2.0, "scummiest")]


def test_clauses_are_scored_once_and_whole():
    own = grammar()
    text = "clean part. you moron, moron; scummy! oxymoron? fine"
    assert [c.strip() for c in own.clauses(text)] == ["you moron, moron", "scummy"]
    assert own.features("")[:8] == [0.0] * 8
    assert own.features(None or "")[8] > 0


def test_scores_on_held_out_rows(spark):
    labels = table(spark, SF, "labels")
    found = toxicity.toxicity(documents(spark, SF), labels.select("doc_id", "toxic"))
    rows = found.join(labels.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    ones = [r.score for r in held if r.toxic]
    zeros = [r.score for r in held if not r.toxic]
    wins = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros)
    assert wins / (len(ones) * len(zeros)) > 0.85
    assert sum(r.predicted for r in held if not r.toxic) <= 0.05 * len(zeros)


def test_held_out_labels_are_not_read(spark, edge_docs, no_docs):
    labels = [(i, int(zlib.crc32(str(i).encode()) % 5 == 0)) for i in range(10)]
    table_ = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    scores = {r.score for r in toxicity.toxicity(edge_docs, table_).collect()}
    assert len(scores) == 1 and max(scores) < 0.01
    assert toxicity.toxicity(edge_docs, table_.limit(0)).count() == len(EDGE_TEXTS)
    assert toxicity.toxicity(no_docs, table_).count() == 0


def corpus():
    draw = random.Random(11)
    vocab = [f"{a}{b}" for a in ("the", "an", "tion", "ing", "er", "on") for b in ("ha", "re", "st", "ou", "ed")]
    item = " ".join(draw.choices(vocab, k=30))
    docs = {}
    for i in range(40):
        lines = [" ".join(draw.choices(vocab, k=12)) for _ in range(4)]
        docs[i] = "\n".join(["shared header line of many texts", *lines] if i % 2 else lines)
    docs[40] = docs[3]
    docs[41] = " ".join(docs[4].split()[:-1]) + " changed"
    docs[42] = docs[5] + "\n" + item
    docs[43] = "too short"
    docs[44] = " | ".join(["###"] * 60)
    docs[45] = None
    docs[46] = "\n".join(["only a shared line"] * 3 + [docs[7]])
    return docs, item


def brute_pipeline(docs, item, good):
    kept = {d: docs[d] for d, v in brute_quality(docs, good).items() if v[2]}
    kept = {d: v[2] for d, v in brute_lines(kept).items()}
    kept = {d: kept[d] for d, c in brute_classes(kept).items() if d == c}
    want = tokens(item)
    kept = {d: t for d, t in kept.items() if brute_tiles(want, tokens(t), 5) < 0.5 * len(want)}
    library = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model")
    )
    return {d: library.encode(t) for d, t in kept.items()}


def test_pipeline_against_brute_force(spark, tmp_path):
    docs, item = corpus()
    rows = [(d, t, "en", None, None) for d, t in docs.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(0, 40, 3)], "doc_id long, quality int").write.parquet(
        f"{folder}/labels.parquet"
    )
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet"
    )
    expected = brute_pipeline(docs, item, set(range(0, 40, 3)))
    found = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, folder).collect()}
    assert found == expected
    # The exact copy lost all its lines; the one empty text left is its own class.
    assert not {42, 43, 44, 45} & set(found) and found[40] == [] and len(found) > 30


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        assert out.count() == 0
    assert len(corpus_pipeline.STAGES) == 5
