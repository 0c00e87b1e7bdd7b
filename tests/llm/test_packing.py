from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest_llm import EDGE_TEXTS
from tokenizers import Tokenizer

from seqbraid.llm import packing
from seqbraid.llm.word_ids import WordIds

WORDS = public_tokenizers.path("word_bpe_49k.json")
POOL = [
    "The", "house", "É", "ñandú", "don't", "we'll", "!!", "...", "a.b", "naïve,", "STRASSE", "ß",
    "İ", "ǅ", "x²", "12.5", "'", "''s", "日本語", "🎉!", "<|endoftext|>", "a<|endoftext|>", "\x00",
    "\x1c", " ", "\t", "\n", "", "é́", "é", "$$$", "Word###", " ", "mañana?", "º", "µ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_word_ids_equal_the_library(library):
    draw = random.Random(5)
    texts = [draw.choice([" ", "\n", ""]).join(draw.choices(POOL, k=draw.randint(0, 40))) for _ in range(600)]
    texts += EDGE_TEXTS
    for entries in (3, 1000):
        own = WordIds(WORDS, entries)
        for part in (texts[:200], texts[200:], texts[:1], []):
            ids, counts = own.encode(pa.array(part, pa.string()))
            want = [expected(library, t) for t in part]
            assert counts.tolist() == [len(w) for w in want]
            assert (ids.tolist() == [i for w in want for i in w]) is True


def test_binary_lengths():
    tokens = np.array([0, 1, 7, 8, 9, 20, 16])
    lengths, count = packing.binary_lengths(tokens, 8)
    assert count.tolist() == [0, 1, 3, 1, 2, 3, 2]
    assert lengths.tolist() == [1, 4, 2, 1, 8, 8, 1, 8, 8, 4, 8, 8]
    with pytest.raises(ValueError):
        packing.binary_lengths(tokens, 12)


def check(rows, docs, library, longest, end_id):
    """Every id lies in one piece, pieces are powers of two, sequences hold one document."""
    found = Counter()
    for r in rows:
        assert r["length"] & (r["length"] - 1) == 0 and 1 <= r["length"] <= longest
        found[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    want = Counter()
    for doc_id, text in docs:
        ids = np.array([*expected(library, text), end_id], "<u4")
        at, length = 0, longest
        while at < len(ids):
            while length > len(ids) - at:
                length //= 2
            crc = zlib.crc32(ids[at : at + length].tobytes())
            want[doc_id, at, length, crc, len(ids)] += 1
            at += length
    assert (found == want) is True


@pytest.mark.parametrize("longest", [8, 4096])
def test_edge_documents(spark, library, edge_docs, longest):
    path = packing.write_sequences(edge_docs, WORDS, longest=longest)
    out = packing.packed(spark, path)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = out.collect()
    check(rows, enumerate(EDGE_TEXTS), library, longest, packing.END_ID)
    assert {r["offset"] for r in rows} == {0}
    sequences = {r["sequence_id"]: r["ids"] for r in packing.read_sequences(spark, path).collect()}
    assert all(len(sequences[r["sequence_id"]]) == 4 * r["length"] for r in rows)


def test_repeated_and_null_ids_are_packed_each(spark, library):
    docs = [(None, "one two"), (None, None), (7, "a b c"), (7, "a b c"), (8, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = packing.packed(spark, packing.write_sequences(df, WORDS)).collect()
    check(rows, docs, library, 4096, packing.END_ID)
    assert sum(r["doc_id"] is None for r in rows) == 3
    assert sum(r["doc_id"] == 7 for r in rows) == 2


def test_empty_table(spark, no_docs):
    out = packing.packed(spark, packing.write_sequences(no_docs, WORDS))
    assert out.count() == 0 and out.schema["doc_id"].dataType.simpleString() == "bigint"
